"""Entity resolution: links by identifiers and names, transitive closure, merging; and screening against watch lists.

Groups of equal identifiers become stars around their least entity, never all pairs, so a
value that many entities share costs rows in proportion to its entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rules import fuzzy_screen, normalise
from .staging import cut

ID_FIELDS = ("mmsi", "icao", "icao_hex")


def match_ids(entities: DataFrame, fields: tuple[str, ...] = ID_FIELDS) -> DataFrame:
    """(a, b, field, confidence 1.0): each entity that shares an identifier with a lesser one of its type, and the least of them.

    Identifiers are columns; null and empty ones link nothing.  Two entities that share two
    identifiers give a row for each.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = entities.select("entity_id", "entity_type", F.explode(F.filter(each, lambda x: F.length(x["value"]) > 0)).alias("x")).select("entity_id", "entity_type", "x.field", "x.value")
    heads = rows.groupBy("entity_type", "field", "value").agg(F.min("entity_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return rows.join(heads, ["entity_type", "field", "value"]).where("entity_id <> b").select(F.col("entity_id").alias("a"), "b", "field", F.lit(1.0).alias("confidence")).distinct()


def closure(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(entity_id, canonical_id): of all entities in links (a, b), the least one reachable, itself included.

    Large and small stars in turn until no link changes; every round is an equi-join and a
    partial minimum, and is cut from the one before.  The rounds needed grow with the logarithm
    of the longest chain, far below the bound, and beyond it an error is raised.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # an end whose neighbours are all lesser keeps its link in the small star, so nothing is lost
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        pairs = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            heads = pairs.select(F.col("v").alias("entity_id")).distinct()
            return pairs.select(F.col("u").alias("entity_id"), F.col("v").alias("canonical_id")).unionByName(heads.select("entity_id", F.col("entity_id").alias("canonical_id")))
        state = now
    raise RuntimeError("the links did not settle")


def merge(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """Entities (entity_id, ..., confidence, is_active, properties MAP) with canonical_id: the canonical one takes over.

    It keeps its own values, fills those it lacks (columns and single properties) from the others
    in the order of their ids, and takes the greatest confidence; the others stay, not active.
    """
    known = canonical.select("entity_id", "canonical_id").distinct()
    rows = entities.join(known, "entity_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "entity_id"))
    rows = rows.withColumn("_rank", F.struct((F.col("entity_id") != F.col("canonical_id")).alias("other"), F.col("entity_id").alias("id")))
    plain = [c for c in entities.columns if c not in ("entity_id", "confidence", "is_active", "properties")]
    first = [F.min_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(f"_{c}") for c in plain]
    grouped = rows.groupBy("canonical_id").agg(F.max("confidence").alias("_confidence"), F.count("*").alias("_n"), *first).where("_n > 1")
    shared = rows.join(grouped.select("canonical_id"), "canonical_id")
    single = shared.select("canonical_id", "_rank", F.explode("properties").alias("key", "value")).groupBy("canonical_id", "key").agg(F.min_by("value", "_rank").alias("value"))
    props = single.groupBy("canonical_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_properties"))
    out = rows.join(grouped, "canonical_id", "left").join(props, "canonical_id", "left")
    head = (F.col("entity_id") == F.col("canonical_id")) & F.col("_n").isNotNull()
    taken = {c: F.when(head, F.coalesce(F.col(f"_{c}.v"), F.col(c))).otherwise(F.col(c)) for c in plain}
    taken["confidence"] = F.when(head, F.col("_confidence")).otherwise(F.col("confidence"))
    taken["properties"] = F.when(head, F.coalesce("_properties", "properties")).otherwise(F.col("properties"))
    taken["is_active"] = F.col("is_active") & (F.col("entity_id") == F.col("canonical_id"))
    return out.select(*[taken.get(c, F.col(c)).alias(c) for c in entities.columns], "canonical_id")


def feedback(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Links without those that the last verdict (a, b, confirmed, ts) on the pair refuses, and with those that it confirms."""
    last = verdicts.groupBy(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).agg(F.max_by("confirmed", "ts").alias("confirmed"))
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return ordered.join(last.where("not confirmed"), ["a", "b"], "left_anti").unionByName(last.where("confirmed").select("a", "b")).distinct()


def normalise_id(value: Column) -> Column:
    """An identifier without signs and spaces, in capitals; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(value.cast("string"), r"[^\p{L}\p{N}]", "")), F.lit(""))


def read_list(rows: DataFrame, separator: str = ";") -> DataFrame:
    """A watch list read as text columns (list_id, list_name, aliases, mmsi, imo): aliases split at the separator, blanks dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), separator), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return rows.withColumn("aliases", parts)


def screen(names: DataFrame, listed: DataFrame, min_score: int = 75) -> DataFrame:
    """(entity_id, list_id, score, id_match, matched, risk): three stages, the best row of each pair.

    Identifiers (mmsi, imo) first; then names equal to a listed name or alias, which end the search
    of that entity by name; then names that are alike.  names: (entity_id, name, mmsi, imo);
    listed: (list_id, list_name, aliases ARRAY, mmsi, imo).
    """
    key = lambda f: normalise_id(F.col(f)).alias("k")
    ids = None
    for f in ("mmsi", "imo"):
        one = names.select("entity_id", key(f)).join(listed.select("list_id", "list_name", key(f)), "k").select("entity_id", "list_id", F.lit(100).alias("score"), F.lit(True).alias("id_match"), F.col("list_name").alias("matched"))
        ids = one if ids is None else ids.unionByName(one)
    every = listed.select("list_id", F.explode(F.array_union(F.array("list_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("list_name")).where("list_name is not null")
    every = every.withColumn("k", normalise(F.col("list_name"))).where("k <> ''").groupBy("list_id", "k").agg(F.min("list_name").alias("list_name"))
    asked = names.select("entity_id", "name", normalise(F.col("name")).alias("k")).where("k <> ''")
    exact = asked.join(every, "k").select("entity_id", "list_id", F.lit(100).alias("score"), F.lit(False).alias("id_match"), F.col("list_name").alias("matched"))
    rest = asked.join(exact.select("entity_id").distinct(), "entity_id", "left_anti")
    variant = every.select(F.struct("list_id", "list_name").alias("list_id"), "list_name")
    alike = fuzzy_screen(rest, variant, min_score).select("entity_id", F.col("list_id.list_id").alias("list_id"), "score", F.lit(False).alias("id_match"), F.col("list_id.list_name").alias("matched"))
    best = ids.unionByName(exact).unionByName(alike).groupBy("entity_id", "list_id").agg(F.max_by(F.struct("score", "id_match", "matched"), F.struct("id_match", "score", "matched")).alias("x")).select("entity_id", "list_id", "x.*")
    risk = F.when(F.col("id_match") | (F.col("score") == 100), "confirmed").when(F.col("score") >= 90, "probable").otherwise("possible")
    return best.withColumn("risk", risk)
