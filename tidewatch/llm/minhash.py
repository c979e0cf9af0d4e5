"""Near-duplicate documents by min-max hashing (op1).

A document is its set of distinct 5-word shingles.  Under each random permutation
both the smallest and the largest image are kept, so one hash evaluation gives two
signature values; 120 permutations give 240 values and 48 bands of five.

1. Documents with equal sets collapse to one class, named by a 128-bit digest of the set and
   numbered; from here on every step works on classes, however many copies one has.
2. The members of a band bucket meet in cells of bounded size, where sketches (two bits of every
   signature value) pick pairs; a cell returns a spanning forest of its pairs, never all.
3. Forest edges are confirmed on full sets: first each class with its likeliest partner, then the
   edges that still join different components.  A class with very many partners is dealt to parts.
4. What edges join, confirmed or not, is a family.  A family that is one component is done.  In the
   others every pair of different components meets once more, by sketches, in bounded cells, and
   only classes with a likely partner there bring their sets to a cell that confirms them.
5. Connected components over all confirmed links.

Defined cases: null or empty text, or text without words -> n_shingles 0, its own
component, kept.  Null doc_id -> never linked, component_id null, kept.  Repeated
rows give repeated output rows; rows that share a doc_id but not a text are documents of
their own, which here share the doc_id.  Extra columns are ignored here; `deduplicate`
passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .common import byte_bound, drop_staged, sieve, staged
from .graph import cells, components, join_classes

SHINGLE, PERMUTATIONS, BANDS, ROWS, THRESHOLD = 5, 120, 48, 5, 75
#: Of the two-bit values of a pair at 0.75, 195 agree on average; fewer than this do with five standard deviations.
SKETCH_AGREE = 164
BUCKET_BLOCK, FAMILY_BLOCK, SUB, PART = 1024, 256, 2, 128


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def shingle_sets(arr) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    word, fold = tc.class_table(tc.NON_SPACE), tc.fold_table()
    buf, offs = tc.text_bytes(arr)
    for a, b in tc.row_groups(offs):
        h, _, _, wo = tc.words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], word, fold)
        grams = tc.ngrams(h, SHINGLE)
        for i in range(b - a):
            s, e = int(wo[i]), int(wo[i + 1])
            if e - s >= SHINGLE:
                yield np.unique(grams[s : e - SHINGLE + 1])
            elif e > s:
                yield tc.ngrams(h[s:e], e - s)
            else:
                yield h[:0]


def min_max(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Signature of 2 * PERMUTATIONS values: minimum and maximum side by side."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = high = None
    for a in range(0, len(x), 1024):
        m = np.multiply.outer(mul, x[a : a + 1024])
        m += add[:, None]
        p, q = m.min(1), m.max(1)
        low, high = (p, q) if low is None else (np.minimum(low, p), np.maximum(high, q))
    return np.stack([low, high], 1).ravel()


def band_keys(sig: np.ndarray) -> np.ndarray:
    part = sig.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        acc = tc.mix(acc + part[:, j])
    return acc.view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    """Order-free 128-bit digest of a set."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(s))
        one = tc.mix(s + np.uint64(77)).sum(dtype=np.uint64) + n
        two = tc.mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(91)).sum(dtype=np.uint64) ^ (n << np.uint64(32))
        return tc.mix(np.array([one, two], np.uint64)).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mul, add = permutations()
    for batch in batches:
        n, key, sigs = [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            key.append(set_key(s) if len(s) else None)
            sigs.append((min_max(s, mul, add) & np.uint32(0xFFFF)).astype(np.uint16).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "digest", "n_shingles", "key", "sig"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys and sketch of every class, from its signature."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, 2 * PERMUTATIONS)
        bands = [band_keys(x) for x in sig]
        two = (sig * np.uint16(40503) >> np.uint16(14)).astype(np.uint8).reshape(len(sig), -1, 4)
        sketch = two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bands, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary())], ["node", "bands", "sketch"])


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many two-bit values agree, row by row."""
    d = x ^ y
    d = (d | d >> 1) & 0x55
    return 4 * x.shape[1] - np.bitwise_count(d).sum(1).astype(np.int64)


def _signs(sketch: np.ndarray) -> np.ndarray:
    """Rows whose product counts the two-bit values that agree."""
    two = np.stack([sketch >> k & 3 for k in (0, 2, 4, 6)], 2).reshape(len(sketch), -1)
    return (two[:, :, None] == np.arange(4)).reshape(len(two), -1).astype(np.float32)


def spanning(agree: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """A heaviest spanning forest of the pairs that agree in at least `least` values."""
    n = len(agree)
    best, parent, left = np.zeros(n), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -1)))
        left[i] = False
        if parent[i] >= 0:
            yield int(parent[i]), i, int(best[i])
        better = left & (agree[i] >= least) & (agree[i] > best)
        best[better] = agree[i][better]
        parent[better] = i


def by_cell(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(first rows of the cells and the end, rows) of the whole cells in a partition sorted by `names`."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part]).combine_chunks()
        place = np.stack([part.column(c).to_numpy() for c in names], 1)
        cuts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1]
        if len(cuts) > 1:
            yield cuts, part.slice(0, int(cuts[-1]))
        held = part.slice(int(cuts[-1]))
    if held is not None:
        yield np.array([0, len(held)]), held


def _sketches(part: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(part), -1)


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, agree): forests of likely pairs, cell by cell."""
    for cuts, part in by_cell(batches, ("band", "cell_i", "cell_j")):
        node, own, sketch = part.column("node").to_numpy(), part.column("own").to_numpy(), _sketches(part)
        cross = part.column("cell_i").to_numpy() != part.column("cell_j").to_numpy()
        a, b, agree = [], [], []
        starts, sizes = cuts[:-1], np.diff(cuts)
        two = starts[sizes == 2]
        same = _agree(sketch[two], sketch[two + 1])
        ok = (same >= SKETCH_AGREE) & (~cross[two] | (own[two] != own[two + 1]))
        a += node[two[ok]].tolist()
        b += node[two[ok] + 1].tolist()
        agree += same[ok].tolist()
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            x = _signs(sketch[s : s + n])
            m = x @ x.T
            np.fill_diagonal(m, 0)
            if cross[s]:
                m[own[s : s + n, None] == own[None, s : s + n]] = 0
            if m.max() >= SKETCH_AGREE:
                for i, j, w in spanning(m, SKETCH_AGREE):
                    a.append(int(node[s + i]))
                    b.append(int(node[s + j]))
                    agree.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int64())], ["a", "b", "agree"])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())], ["node", "set"])


def _confirm_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one centre to its partners of one part."""
    centre, out = None, []
    for node, hub, s in sorted(zip(pdf["node"], pdf["hub"], pdf["set"]), key=lambda x: x[0] != x[1]):
        if node == hub:
            centre = np.frombuffer(s, np.uint64)
        elif alike(centre, np.frombuffer(s, np.uint64)):
            out.append((hub, node))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct edges(a, b) whose sets reach the threshold; the edges of b are confirmed in parts of about PART."""
    degree = edges.groupBy("b").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    dealt = edges.join(degree, "b").select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"))
    hubs = degree.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("node"))
    rows = dealt.unionByName(hubs).join(sets, "node").repartition("hub", "part")
    return rows.groupBy("hub", "part").applyInPandas(_confirm_part, "a long, b long")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell, the classes with a likely partner of another component, by the sub-cells of about 2 x PART in which they meet."""
    for cuts, part in by_cell(batches, ("family", "cell_i", "cell_j")):
        columns = {c: part.column(c).to_numpy() for c in ("family", "cell_i", "cell_j", "own", "node", "label")}
        sketch = _sketches(part)
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s < 2:
                continue
            own, node, label = (columns[c][s:e] for c in ("own", "node", "label"))
            i, j = int(columns["cell_i"][s]), int(columns["cell_j"][s])
            x = _signs(sketch[s:e])
            near = (x @ x.T >= SKETCH_AGREE) & (label[:, None] != label[None, :])
            if i != j:
                near &= own[:, None] != own[None, :]
            p, q = np.nonzero(near)
            if not len(p):
                continue
            sub = own.astype(np.int64) * SUB + (tc.mix(node.view(np.uint64)) % np.uint64(SUB)).astype(np.int64)
            rows = np.unique(np.stack([np.minimum(sub[p], sub[q]), np.maximum(sub[p], sub[q]), p], 1), axis=0)
            for column, value in zip(out, (np.full(len(rows), columns["family"][s]), rows[:, 0], rows[:, 1], node[rows[:, 2]], label[rows[:, 2]], rows[:, 2] + s)):
                column.append(value)
        flat = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in flat[:5]), part.column("sketch").combine_chunks().take(pa.array(flat[5]))], ["family", "sub_i", "sub_j", "node", "label", "sketch"])


def links_between(node: np.ndarray, label: np.ndarray, sketches: list[bytes], sets: list[bytes]) -> list[tuple[int, int]]:
    """Spanning links of the confirmed pairs of different components in a cell."""
    x = _signs(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(node), -1))
    near = np.triu((x @ x.T >= SKETCH_AGREE) & (label[:, None] != label[None, :]))
    parts = [np.frombuffer(s, np.uint64) for s in sets]
    up = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(near)):
        p, q = root(int(label[i])), root(int(label[j]))
        if p != q and alike(parts[i], parts[j]):
            up[q] = p
            links.append((int(node[i]), int(node[j])))
    return links


def _confirm_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(links_between(pdf["node"].to_numpy(), pdf["label"].to_numpy(), list(pdf["sketch"]), list(pdf["set"])), columns=["a", "b"], dtype="int64")


def _stars(labels: DataFrame) -> DataFrame:
    return labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges(a, b, ...) with the components la and lb of their ends; a class in none is its own."""
    for end in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    return edges


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, classes, final): rows with their set keys, one row per class, and the component of every class."""
    byte_bound(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    signed = staged(docs.mapInArrow(_sign, "doc_id long, digest binary, n_shingles long, key binary, sig binary"), "signed")
    named = signed.where("key is not null and doc_id is not null")
    classes = named.groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    dealt = staged(classes.select("node", "sig").mapInArrow(_deal, "node long, bands array<long>, sketch binary"), "dealt")
    sketches = dealt.select("node", "sketch")
    placed = cells(dealt.select("node", F.explode("bands").alias("band")), "band", "node", BUCKET_BLOCK, 2, sketches)
    placed = placed.sortWithinPartitions("band", "cell_i", "cell_j").select("node", "band", "cell_i", "cell_j", "own", "sketch")
    pairs = placed.mapInArrow(_bucket_pairs, "a long, b long, agree long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "agree")
    pairs = staged(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")

    families = staged(components(pairs.select("a", "b")).toDF("node", "family"), "families")
    reps = staged(classes.join(families, "node").select("node", "rep.doc_id", "rep.digest"), "reps")
    # only the texts of classes in a family, and the few others that the sieve lets through, are shuffled
    texts = docs.where(sieve(reps, "digest")(F.col("digest"))).join(reps, ["doc_id", "digest"]).select("node", "text").mapInArrow(_sets, "node long, set binary")
    sets = staged(texts.groupBy("node").agg(F.first("set").alias("set")), "sets")

    # each class with its likeliest partner, ties in an order of their own for each class
    ends = pairs.select("a", "b", "agree").union(pairs.select("b", "a", "agree"))
    best = ends.groupBy("a").agg(F.max(F.struct("agree", F.xxhash64("a", "b"), "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    first = staged(confirmed(best, sets), "first")
    near = staged(components(first), "labels")
    open_ = _labelled(pairs.join(best.union(best.select("b", "a")).distinct(), ["a", "b"], "left_anti"), near).where("la <> lb").select("a", "b")
    # what is joined already goes on as one edge a class
    labels = staged(components(_stars(near).unionByName(confirmed(open_, sets))), "labels")

    members = families.join(labels, "node", "left").select("node", "family", F.coalesce("label", "node").alias("label"))
    unlike = members.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("family")
    again = cells(members.join(unlike, "family").join(sketches, "node"), "family", "node", FAMILY_BLOCK)
    again = again.sortWithinPartitions("family", "cell_i", "cell_j").select("family", "cell_i", "cell_j", "own", "node", "label", "sketch")
    likely = again.mapInArrow(_likely, "family long, sub_i long, sub_j long, node long, label long, sketch binary").join(sets, "node")
    more = staged(likely.repartition("family", "sub_i", "sub_j").groupBy("family", "sub_i", "sub_j").applyInPandas(_confirm_cell, "a long, b long"), "more")
    whole = components(_stars(labels).unionByName(more))

    found = whole.join(classes.select("node", "rep"), "node")
    lowest = found.groupBy("label").agg(F.min("rep").alias("first"))
    linked = found.join(lowest, "label").select("node", "first")
    final = staged(classes.join(linked, "node", "left").select("key", "copies", F.coalesce("first", "rep").alias("first")), "final")
    drop_staged(classes, dealt, pairs, families, reps, sets, first, near, labels, more)
    return signed, named, final


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    signed, named, final = _classes(docs)
    with_key = join_classes(named.select("doc_id", "n_shingles", "key"), final).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    without = signed.where("key is null or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("component_id"))
    out = with_key.unionByName(without)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component of docs stays, with all its columns: one of the least (doc_id, digest of the text).

    The decision is by doc_id and text, so a document that shares only its doc_id with a
    copy stays.  Rows without words are each kept, and so are rows without doc_id.
    """
    _, named, final = _classes(docs)
    decided = join_classes(named.select("doc_id", "digest", "key"), final)
    wins = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    # copies are few beside the rest; of the kept rows only those that repeat are compared once more
    judged = decided.groupBy("doc_id", "digest").agg(F.min(wins.cast("int")).alias("wins"), F.count("*").alias("n")).where("wins = 0 or n > 1")
    judged = staged(judged.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "wins"), "judged")
    text = F.col("text").cast("string")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.unhex(F.md5(text.cast("binary"))).alias("_digest"))
    # texts the sieve turns away have no copy and are not shuffled
    perhaps = sieve(judged, "_digest")(F.col("_digest"))
    rest = staged(boxed.where(perhaps).join(judged, ["_id", "_digest"], "left").where("wins is null or wins = 1"), "rest")
    once = rest.where("wins = 1").groupBy("_id", "_digest").agg(F.first("_doc").alias("_doc"))
    return boxed.where(~perhaps).select("_doc.*").unionByName(rest.where("wins is null").select("_doc.*")).unionByName(once.select("_doc.*"))
