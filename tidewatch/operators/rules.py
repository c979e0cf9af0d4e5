"""Monitor rules, threat scores, watch-list screening, entity resolution, governance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from ..functions import geo
from .names import screened

#: Rows of a watch list, and names, that one task of a screening holds.
LISTED_ROWS, NAME_ROWS = 1 << 17, 1 << 14

OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def parse_condition(text: str) -> tuple[str, str, float]:
    import re

    m = re.fullmatch(r"\s*(\w+)\s*(>=|<=|!=|=|>|<)\s*(-?\d+(?:\.\d+)?)\s*", text)
    if not m:
        raise ValueError(f"not a condition: {text!r}")
    return m[1], m[2], float(m[3])


def threshold_alerts(rows: DataFrame, rule: str, condition: str) -> DataFrame:
    prop, op, value = parse_condition(condition)
    return rows.where(OPS[op](F.col(prop), value)).select(F.lit(rule).alias("rule"), "entity_id", F.col(prop).cast("double").alias("observed"))


def geofence_alerts(rows: DataFrame, rule: str, lat: float, lon: float, radius_km: float) -> DataFrame:
    return rows.where(geo.point_in_radius(F.col("lat"), F.col("lon"), lat, lon, radius_km)).select(F.lit(rule).alias("rule"), "entity_id")


def stale_alerts(tracks: DataFrame, as_of: Column, max_age_s: int) -> DataFrame:
    g = tracks.groupBy("entity_id").agg(F.max("ts").alias("last_seen"))
    age = F.unix_timestamp(as_of) - F.unix_timestamp("last_seen")
    return g.select("entity_id", age.alias("age_s")).where(F.col("age_s") > max_age_s)


def speed_jumps(tracks: DataFrame, limit: float) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id")
    jump = F.abs(F.col("speed") - F.lag("speed").over(w))
    return tracks.withColumn("jump", jump).where(F.col("jump") > limit).select("entity_id", "event_id", F.round("jump", 6).alias("jump"))


def anchored(key: list[str], seconds: int, ts: str = "ts", tie: str = "event_id"):
    """A function for mapInPandas over rows sorted within partitions by key, time and tie: keeps a row if the last kept
    row of its key is at least `seconds` older.  Works as a stream, so no group is ever held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, anchor = None, None
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[key].itertuples(index=False, name=None), pdf[ts]):
                if k != last_key or (t - anchor).total_seconds() >= seconds:
                    last_key, anchor = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield pdf[keep]

    return run


def anchored_dedup(rows: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """Greedy window anchored at the first row seen of each key (cooldowns, duplicate suppression)."""
    return rows.repartition(*key).sortWithinPartitions(*key, "ts", "event_id").mapInPandas(anchored(key, seconds), rows.schema)


def threat_scores(rows: DataFrame, sites: list[tuple[str, float, float, float]], as_of: Column) -> DataFrame:
    """rows(entity_id, sanctioned, anomaly, lat, lon, last_seen, speed, speed_limit) -> score and level.

    Weights .35 sanctions, .25 anomaly, .20 nearness to a site, .12 silence, .08 speed excess.
    """
    near = F.lit(0.0)
    for _, lat, lon, radius in sites:
        d = geo.haversine_km(F.col("lat"), F.col("lon"), lat, lon)
        near = F.greatest(near, F.when(d <= radius, 100.0).when(d <= 2 * radius, (2 * radius - d) / radius * 100).otherwise(0.0))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    dark = clamp((F.unix_timestamp(as_of) - F.unix_timestamp("last_seen")) / 60 / 1440 * 100)
    over = clamp(F.when(F.col("speed") > F.col("speed_limit"), (F.col("speed") - F.col("speed_limit")) / F.col("speed_limit") * 100).otherwise(0.0))
    score = clamp(0.35 * F.when(F.col("sanctioned"), 100.0).otherwise(0.0) + 0.25 * clamp(F.col("anomaly")) + 0.20 * near + 0.12 * dark + 0.08 * over)
    score = F.round(score, 2)
    whole = F.floor(score)
    level = F.when(whole <= 24, "green").when(whole <= 49, "yellow").when(whole <= 74, "orange").otherwise("red")
    return rows.select("entity_id", score.alias("score"), level.alias("level"))


def threat_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("level").agg(F.count("*").alias("n"))


def level_changes(scored: DataFrame, order: list[str]) -> DataFrame:
    """scored(entity_id, level, ...): rows whose level differs from the one before; the first counts against green."""
    w = Window.partitionBy("entity_id").orderBy(*order)
    return scored.withColumn("before", F.coalesce(F.lag("level").over(w), F.lit("green"))).where("before <> level")


def normalise(name: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9]+", " "), r"\s+", " ")))


def exact_screen(names: DataFrame, listed: DataFrame) -> DataFrame:
    a = names.select("entity_id", normalise(F.col("name")).alias("k"))
    b = listed.select("list_id", normalise(F.col("list_name")).alias("k"))
    return a.join(b, "k").select("entity_id", "list_id")


def fuzzy_screen(names: DataFrame, listed: DataFrame, min_score: int = 75, share: float = 0.3) -> DataFrame:
    """Listed names that share at least `share` of the query's different trigrams and whose edit distance scores min_score.

    Names under 4 characters, of which there are few different ones, need no trigram.  List and names are dealt
    into parts of bounded size, each pair of parts meets in one task, and the walk over a trie (operators/names)
    takes the place of comparing all pairs; equal names are compared once a part.
    """
    a = names.select("entity_id", normalise(F.col("name")).alias("name")).where("length(name) >= 1").distinct()
    b = listed.select("list_id", normalise(F.col("list_name")).alias("name")).where("length(name) >= 3").distinct()
    deal_b = max(1, -(-b.count() // LISTED_ROWS))
    deal_a = max(1, -(-a.count() // NAME_ROWS), -(-2 * names.sparkSession.sparkContext.defaultParallelism // deal_b))
    one, many = F.pmod(F.xxhash64("name", "entity_id"), F.lit(deal_a)), F.pmod(F.xxhash64("list_id", "name"), F.lit(deal_b))
    a = a.select("entity_id", F.lit(None).cast(listed.schema["list_id"].dataType).alias("list_id"), "name", (one * deal_b).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(deal_b - 1))).alias("i"), F.lit(1).alias("side"))
    b = b.select(F.lit(None).cast(names.schema["entity_id"].dataType).alias("entity_id"), "list_id", "name", many.alias("k"), F.explode(F.sequence(F.lit(0), F.lit((deal_a - 1) * deal_b), F.lit(deal_b))).alias("i"), F.lit(0).alias("side"))
    both = a.unionByName(b).select((F.col("k") + F.col("i")).cast("int").alias("part"), "side", "entity_id", "list_id", "name")
    both = both.repartitionById(deal_a * deal_b, F.col("part")).sortWithinPartitions("part", "side")
    schema = T.StructType([T.StructField("entity_id", names.schema["entity_id"].dataType), T.StructField("list_id", listed.schema["list_id"].dataType), T.StructField("score", T.IntegerType())])
    found = both.mapInArrow(lambda batches: screened(batches, min_score, share), schema)
    return found.withColumn("risk", F.when(F.col("score") == 100, "confirmed").when(F.col("score") >= 90, "probable").otherwise("possible"))


def match_names(left: DataFrame, right: DataFrame, min_jaccard: float = 0.8) -> DataFrame:
    """Pairs of equal block whose names' character sets overlap enough."""
    chars = lambda c: F.array_distinct(F.split(F.lower(c), ""))
    a = left.select(F.col("entity_id").alias("a"), "block", chars(F.col("name")).alias("x"))
    b = right.select(F.col("entity_id").alias("b"), "block", chars(F.col("name")).alias("y"))
    j = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return a.join(b, "block").where("a < b").withColumn("jaccard", F.round(j, 6)).where(F.col("jaccard") > min_jaccard).select("a", "b", "jaccard")


def federated_merge(local: DataFrame, remote: DataFrame, cap: float = 0.9) -> DataFrame:
    """Per id the more confident of the two; remote confidence is capped and must be strictly greater to win."""
    columns = local.columns
    rest = [c for c in columns if c != "entity_id"]
    both = local.withColumn("_local", F.lit(1)).unionByName(remote.withColumn("confidence", F.least("confidence", F.lit(cap))).withColumn("_local", F.lit(0)))
    best = both.groupBy("entity_id").agg(F.max_by(F.struct(*rest), F.struct("confidence", "_local")).alias("s"))
    return best.select(*[F.col(c) if c == "entity_id" else F.col(f"s.{c}") for c in columns])


def chain_hash(fields: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).cast("binary"), 256)


def verify_chain(log: DataFrame, fields: list[str], bucket: int = 10_000) -> DataFrame:
    """Rows of (seq, previous_hash, content_hash, fields) whose hash or link is wrong.

    A row's predecessor is found by an equi-join on seq - 1, not by one global order.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("content_hash").alias("expected"))
    rows = log.join(before, "seq", "left")
    bad_link = F.col("previous_hash") != F.coalesce("expected", F.lit(""))
    return rows.where(bad_link | (F.col("content_hash") != chain_hash(["previous_hash", *fields]))).select("seq")


def allowed(rows: DataFrame, policies: list[dict]) -> DataFrame:
    """policies: {'effect': 'allow' | 'deny', 'column': ..., 'values': [...]}; deny wins, without an allow nothing passes."""
    match = lambda p: F.col(p["column"]).isin(p["values"])
    deny, allow = F.lit(False), F.lit(False)
    for p in policies:
        if p["effect"] == "deny":
            deny = deny | match(p)
        else:
            allow = allow | match(p)
    return rows.where(allow & ~F.coalesce(deny, F.lit(False)))


def dominates(level: Column, compartments: Column, clearance: int, held: list[str]) -> Column:
    return (level <= clearance) & (F.size(F.array_except(compartments, F.array(*[F.lit(h) for h in held]))) == 0)


def quantile_envelope(points: DataFrame, value: str, keep: int = 2048, warm_up: int = 64, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Excursion of each value beyond the envelope of the points before it (nearest rank, floor)."""
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id").rowsBetween(-keep, -1)
    r = points.withColumn("h", F.array_sort(F.collect_list(value).over(w))).withColumn("n", F.size("h")).where(F.col("n") >= warm_up)
    at = lambda q: F.element_at("h", (F.floor((F.col("n") - 1) * q) + 1).cast("int"))
    span = F.greatest(at(high) - at(low), F.lit(1e-9))
    out = F.greatest(at(low) - F.col(value), F.col(value) - at(high), F.lit(0.0)) / span
    return r.select("entity_id", "event_id", F.round(F.least(out * 100, F.lit(100.0)), 4).alias("score"))


def monitor(states: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """(rule_id, entity_id, kind, observed): all enabled rules of a table over the latest states.

    rules: (rule_id, enabled, entity_type or *, kind, property, op, value, lat, lon, radius_km,
    seconds); kinds: threshold, geofence, stale, speed_jump.  states: (entity_id, entity_type, lat,
    lon, ts, previous_speed, speed, properties MAP).  A rule that lacks what its kind needs, or
    whose property is no number, raises nothing.  Rules join by type, those for * over all
    states; the table of rules is what people write by hand.
    """
    s = states.withColumn("_type", F.explode(F.array(F.lower("entity_type"), F.lit("*"))))
    r = rules.where("enabled").select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    both = s.join(r, F.col("_type") == F.lower("r_entity_type"))
    seen = F.element_at("properties", F.col("r_property")).try_cast("double")
    met = F.lit(False)
    for op, test in OPS.items():
        near = F.abs(seen - F.col("r_value")) < 1e-9
        met = F.when(F.col("r_op") == op, near if op == "=" else ~near if op == "!=" else test(seen, F.col("r_value"))).otherwise(met)
    away = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("ts")).cast("double")
    jump = F.abs(F.col("speed") - F.col("previous_speed"))
    kind = F.col("r_kind")
    observed = F.when(kind == "threshold", seen).when(kind == "geofence", away).when(kind == "stale", age).when(kind == "speed_jump", jump)
    hit = F.when(kind == "threshold", met).when(kind == "geofence", away <= F.col("r_radius_km")).when(kind == "stale", age > F.col("r_seconds")).when(kind == "speed_jump", jump > F.col("r_value"))
    return both.where(hit).select(F.col("r_rule_id").alias("rule_id"), "entity_id", F.col("r_kind").alias("kind"), F.round(observed, 6).alias("observed"))


def fence_transitions(points: DataFrame, fence: str, lat: float, lon: float, radius_km: float, mode: str = "both") -> DataFrame:
    """(fence, entity_id, event_id, transition): points at which an entity enters or leaves a circle; the first point inside enters."""
    inside = geo.point_in_radius(F.col("lat"), F.col("lon"), lat, lon, radius_km)
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id")
    r = points.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_was", F.coalesce(F.lag("_in").over(w), F.lit(False))).where("_in <> _was")
    r = r.select(F.lit(fence).alias("fence"), "entity_id", "event_id", F.when(F.col("_in"), "enter").otherwise("exit").alias("transition"))
    return r if mode == "both" else r.where(F.col("transition") == mode)


def open_alerts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts that nobody has acknowledged, newest first; ties by id."""
    return alerts.join(acks.select("alert_id").distinct(), "alert_id", "left_anti").orderBy(F.col("ts").desc(), "alert_id")


def alert_events(alerts: DataFrame) -> DataFrame:
    """Alerts (alert_id, rule, entity_id, ts, ...) as rows of the event log."""
    data = F.to_json(F.struct(*[c for c in alerts.columns if c not in ("entity_id", "ts")]))
    return alerts.select(F.concat(F.lit("alert-"), F.col("alert_id").cast("string")).alias("event_id"), "entity_id", F.lit("alert").alias("event_type"), "ts", data.alias("data"))


def by_level(scores: DataFrame, least: str) -> DataFrame:
    """Scores of a level or above, highest first; ties by id."""
    levels = ["green", "yellow", "orange", "red"]
    return scores.where(F.col("level").isin(levels[levels.index(least):])).orderBy(F.col("score").desc(), "entity_id")


def threat_share(scores: DataFrame) -> DataFrame:
    """(n, percent): all scores, and the percentage that is orange or red."""
    high = F.count_if(F.col("level").isin("orange", "red"))
    return scores.agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(high * 100.0, F.count("*")), F.lit(0.0)), 4).alias("percent"))


def append_audit(log: DataFrame, new: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """Log (seq, previous_hash, content_hash, ...) with new rows chained to its end in their order.

    A chain is serial: its rows pass one task as a stream, with the last hash alone held.  Chains of
    independent writers are therefore logs of their own.
    """
    import hashlib

    last = log.agg(F.max(F.struct("seq", "content_hash")).alias("x")).first()["x"]
    seq0, hash0 = (last["seq"], last["content_hash"]) if last else (0, "")
    columns = log.columns
    rest = [c for c in columns if c not in ("seq", "previous_hash", "content_hash")]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, before = seq0, hash0
        for pdf in batches:
            out = []
            for row in pdf[rest].to_dict("records"):
                seq += 1
                row |= {"seq": seq, "previous_hash": before}
                text = "|".join("" if row[f] is None else str(row[f]) for f in ["previous_hash", *fields])
                before = hashlib.sha256(text.encode()).hexdigest()
                out.append(row | {"content_hash": before})
            yield pd.DataFrame(out, columns=columns)

    tail = new.select(*rest, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).repartition(1).sortWithinPartitions(*[f"_o{i}" for i in range(len(order))])
    return log.unionByName(tail.mapInPandas(chain, log.schema))
