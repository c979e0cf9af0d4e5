"""Mixing sources to target weights (op4), with DataFrame operations only.

Temperature mixing: a source with token share p gets weight p**t / sum(p**t).  Both
goals are monotone in the exponent t, so it is bisected on a grid of 2**-20, many grid
points a round, over the table of sources (never collected):
  entropy     the largest t whose weights have at least `entropy` of the highest entropy,
  repetition  the smallest t at which no source is seen more than `max_epochs` times;
the larger of the two is used, so the repetition limit holds whenever t = 1 allows it.
`budget` is in tokens; left out, it is the least with which every document is seen.

The weights are realised as budgeted block permutations.  A source is cut into BLOCKS
blocks, and as many more for every further BLOCK_ROWS rows of the table, by a hash of the id; each epoch has its own order of blocks and of documents in
a block.  A source is seen for as many whole epochs as its share of the budget pays,
then for a prefix of the next epoch's permutation: whole blocks, and of the block that
crosses the budget the documents before the cut.  Only sums by (source, block) and the
documents of those cut blocks are ever ordered, so a hot source is spread over its blocks.

A row is one visit: `epoch`, `block_rank` (the block's place in its source's epoch) and
`order_key` (the order within the block).  n_tokens counts words between white space.

Defined cases: a null source is a source of its own; null or empty text has 0 tokens;
a source without any token is seen once; null ids share one place in the order, and
repeated rows are visited each, and rows that share a doc_id but not a source each in its own; an empty table gives an empty mix.  Extra columns stay,
but for those with a name that is added here, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import staged

ENTROPY, MAX_EPOCHS, BLOCKS, SEED = 0.97, 2.0, 512, "mix"
GRID, POINTS, BLOCK_ROWS = 1 << 20, 32, 50_000_000
BROADCAST_ROWS = 100_000


def _md5(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _number(hex_text: Column, modulus: int) -> Column:
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("long") % modulus


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def blocks_for(rows: int) -> int:
    return BLOCKS * max(1, -(-rows // BLOCK_ROWS))


def _keys(docs: DataFrame, blocks: int) -> dict[str, Column]:
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("n"))
    text = F.col("text").cast("string")
    return {"_id": ident, "_source": source, "_block": _number(_md5(ident), blocks), "n_tokens": F.when(text.isNull(), F.lit(0).cast("long")).otherwise(tokens_of(text))}


def exponent(sources: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> float:
    """The temperature exponent for sources(tokens), tokens > 0."""
    whole = sources.agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.max("tokens").alias("most")).first()
    if not whole["n"]:
        return 1.0
    share = sources.select((F.col("tokens") / F.lit(float(whole["total"]))).alias("p"))

    def at(points: list[int]) -> dict[int, tuple[float, float]]:
        """Entropy and the most epochs of a source, for each grid point."""
        grid = share.withColumn("k", F.explode(F.array(*[F.lit(k) for k in points]))).withColumn("w", F.pow("p", F.col("k") / F.lit(float(GRID))))
        sums = grid.groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("p")).alias("most"), F.max(F.col("p") / F.col("w")).alias("large"))
        epochs = F.col("most") * F.col("large") if budget is None else F.col("most") / F.col("z") * F.lit(float(budget) / float(whole["total"]))
        rows = sums.select("k", (F.log("z") - F.col("wl") / F.col("z")).alias("h"), epochs.alias("e")).collect()  # one row for each of at most POINTS + 1 grid points
        return {r["k"]: (r["h"], r["e"]) for r in rows}

    import math

    target = entropy * math.log(whole["n"])

    def first(good) -> int:
        """The smallest grid point from which `good` holds, GRID + 1 if none; good is monotone."""
        low, high = -1, GRID + 1  # not good at low, good at high
        while high - low > 1:
            step = max(1, (high - low) // POINTS)
            points = list(range(low + step, min(high, GRID + 1), step))
            seen = at(points)
            for k in points:
                if good(*seen[k]):
                    high = k
                    break
                low = k
        return high

    eased = first(lambda h, e: h < target - 1e-12) - 1
    held = min(first(lambda h, e: e <= max_epochs + 1e-12), GRID)
    return max(eased, held, 0) / GRID


def plan(docs: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None, seed: str = SEED, blocks: int = BLOCKS) -> DataFrame:
    """Visits by block: (_source, _block, epoch, block_rank, last_key); last_key null means the whole block."""
    small = staged(docs.select(*[c.alias(n) for n, c in _keys(docs, blocks).items()]), "mix")
    by_block = staged(small.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("size")), "blocks")
    sources = by_block.groupBy("_source").agg(F.sum("size").alias("tokens"))
    t = exponent(sources.where("tokens > 0"), entropy, max_epochs, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(t))).otherwise(F.lit(0.0))
    weighed = sources.withColumn("raw", raw)
    sums = weighed.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raw"))).alias("least")).first()
    z, least = sums["z"] or 1.0, sums["least"] or 0.0
    spend = float(budget) / z if budget is not None else float(least)  # tokens per unit of raw weight
    share = weighed.withColumn("paid", F.round(F.col("raw") * F.lit(spend), 3))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("paid") / F.col("tokens") + 1e-9)).otherwise(F.lit(1)).cast("long")
    share = share.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("paid") - F.col("whole") * F.col("tokens")))

    visits = by_block.join(share.select("_source", "whole", "rest"), "_source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    visits = visits.withColumn("turn", _md5(F.lit(seed), F.col("epoch").cast("string"), F.col("_block").cast("string")))
    order = Window.partitionBy("_source", "epoch").orderBy("turn", "_block")  # at most `blocks` rows
    visits = visits.withColumn("block_rank", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order))
    visits = staged(visits.where("epoch < whole or upto - size < rest").withColumn("left", F.when(F.col("epoch") < F.col("whole"), None).when(F.col("upto") <= F.col("rest"), None).otherwise(F.col("rest") - (F.col("upto") - F.col("size")))), "visits")

    cut = visits.where("left is not null").select("_source", "_block", "epoch", "left")
    inside = small.join(_light(cut), ["_source", "_block"]).withColumn("key", _md5(F.lit(seed), F.col("epoch").cast("string"), F.col("_id")))
    running = inside.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("_source", "_block", "epoch").orderBy("key")))
    ends = running.where(F.col("upto") <= F.col("left")).groupBy("_source", "_block", "epoch").agg(F.max("key").alias("last_key"))
    done = visits.join(ends, ["_source", "_block", "epoch"], "left")
    return done.select("_source", "_block", "epoch", F.col("block_rank").cast("long").alias("block_rank"), F.when(F.col("left").isNull(), None).otherwise(F.coalesce("last_key", F.lit(""))).alias("last_key"))


def _light(rows: DataFrame) -> DataFrame:
    """Broadcast only where the table is proven small; beyond that it is joined."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def mix(docs: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None, seed: str = SEED) -> DataFrame:
    """docs, one row for every visit, plus n_tokens, epoch, block_rank and order_key."""
    blocks = blocks_for(docs.count())
    decided = staged(plan(docs, entropy, max_epochs, budget, seed, blocks), "plan")
    added = {"n_tokens", "epoch", "block_rank", "order_key"}
    own = [c for c in docs.columns if c not in added]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), *[c.alias(n) for n, c in _keys(docs, blocks).items()])
    rows = keyed.join(_light(decided), ["_source", "_block"]).withColumn("order_key", _md5(F.lit(seed), F.col("epoch").cast("string"), F.col("_id")))
    rows = rows.where(F.col("last_key").isNull() | (F.col("order_key") <= F.col("last_key")))
    return rows.select("_doc.*", "n_tokens", "epoch", "block_rank", "order_key")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block_rank, order_key of every visit."""
    return mix(docs.select("doc_id", "text", "source")).drop("text")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce('s:' || source, 'n') AS src,
         coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0) AS n_tokens
  FROM documents),
b AS (SELECT *, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % (SELECT {BLOCKS} * greatest(1, CAST(ceil(count(*) / {BLOCK_ROWS}.0) AS BIGINT)) FROM d) AS blk FROM d),
bs AS (SELECT src, blk, CAST(sum(n_tokens) AS BIGINT) AS size FROM b GROUP BY src, blk),
s AS (SELECT src, CAST(sum(size) AS DOUBLE) AS tokens FROM bs GROUP BY src),
p AS (SELECT tokens / (SELECT sum(tokens) FROM s) AS p FROM s WHERE tokens > 0),
g AS (SELECT k, sum(pow(p, k / {GRID}.0e0)) AS z, sum(pow(p, k / {GRID}.0e0) * ln(pow(p, k / {GRID}.0e0))) AS wl,
             max(pow(p, k / {GRID}.0e0) / p) * max(p / pow(p, k / {GRID}.0e0)) AS e
      FROM p, range(0, {GRID + 1}) r(k) GROUP BY k),
t AS (SELECT greatest(coalesce(max(k) FILTER (WHERE ln(z) - wl / z >= {ENTROPY} * ln((SELECT count(*) FROM p)) - 1e-12), 0),
                      coalesce(min(k) FILTER (WHERE e <= {MAX_EPOCHS} + 1e-12), {GRID})) / {GRID}.0e0 AS t FROM g),
w AS (SELECT src, tokens, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM s), (SELECT t FROM t)) ELSE 0 END AS raw FROM s),
pay AS (SELECT src, tokens, round(raw * (SELECT max(tokens / raw) FROM w WHERE tokens > 0), 3) AS paid FROM w),
f AS (SELECT src, tokens, paid, CAST(CASE WHEN tokens > 0 THEN floor(paid / tokens + 1e-9) ELSE 1 END AS BIGINT) AS whole FROM pay),
v0 AS (SELECT bs.src, blk, size, whole, greatest(0, paid - whole * tokens) AS rest, unnest(range(0, whole + 1)) AS epoch FROM bs JOIN f USING (src)),
v1 AS (SELECT *, md5('{SEED}:' || epoch || ':' || blk) AS turn FROM v0),
v AS (SELECT *, row_number() OVER (PARTITION BY src, epoch ORDER BY turn, blk) AS block_rank,
             sum(size) OVER (PARTITION BY src, epoch ORDER BY turn, blk) AS upto FROM v1),
x AS (SELECT b.doc_id, b.source, b.n_tokens, v.epoch, v.block_rank, md5('{SEED}:' || v.epoch || ':' || b.id) AS order_key,
             v.whole, v.upto, v.size, v.rest, b.src, b.blk FROM b JOIN v ON b.src = v.src AND b.blk = v.blk),
y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY src, blk, epoch ORDER BY order_key) AS run FROM x)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(block_rank AS BIGINT) AS block_rank, order_key
FROM y WHERE epoch < whole OR (upto - size < rest AND (upto <= rest OR run <= rest - (upto - size)))
"""
