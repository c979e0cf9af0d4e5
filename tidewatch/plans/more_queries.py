"""Registered queries of resolution, screening, monitors, exports, and models over features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, resolve, rules, store, tracks
from ..streaming import streams
from . import model
from .queries import AMSTERDAM, NEAR, T, THREAT, WITH_ENT, _threat, ents, hav, register


def _shared(spark, d):
    """Customers of whom three share one identifier, and the first of two such threes another."""
    k = F.col("c_custkey")
    rows = model.read(spark, d, "customer").select(
        F.concat(F.lit("customer-"), k.cast("string")).alias("entity_id"), F.lit("customer").alias("entity_type"), F.when(k % 6 == 5, F.col("c_name")).alias("name"),
        (k % 50 / 100.0).alias("confidence"), F.lit(True).alias("is_active"), F.create_map(F.concat(F.lit("p"), (k % 6).cast("string")), k.cast("string")).alias("properties"),
        F.floor(k / 3).alias("mmsi"), F.when(k % 3 == 0, F.floor(k / 6)).alias("icao"))
    return rows


@register("resolve_ids", """
WITH c AS (SELECT 'customer-' || c_custkey AS id, c_custkey // 3 AS m, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 6 END AS i FROM customer)
SELECT id AS a, b, 'mmsi' AS field, 1.0e0 AS confidence FROM (SELECT id, min(id) OVER (PARTITION BY m) AS b FROM c) WHERE id <> b
UNION ALL SELECT id, b, 'icao', 1.0e0 FROM (SELECT id, min(id) OVER (PARTITION BY i) AS b FROM c WHERE i IS NOT NULL) WHERE id <> b""")
def _(spark, d):
    return resolve.match_ids(_shared(spark, d), ("mmsi", "icao"))


GROUPS = "SELECT c_custkey AS k, c_name, 'customer-' || c_custkey AS entity_id, min('customer-' || c_custkey) OVER g AS canonical_id, count(*) OVER g AS n FROM customer WINDOW g AS (PARTITION BY c_custkey // 6)"


@register("resolve_groups", f"SELECT entity_id, canonical_id FROM ({GROUPS}) WHERE n > 1")
def _(spark, d):
    return resolve.closure(resolve.match_ids(_shared(spark, d), ("mmsi", "icao")))


@register("merge_entities", f"""
WITH g AS ({GROUPS})
SELECT entity_id, canonical_id, CASE WHEN k % 6 = 5 THEN c_name WHEN entity_id = canonical_id THEN (SELECT min(x.c_name) FROM g x WHERE x.canonical_id = g.canonical_id AND x.k % 6 = 5) END AS name,
  CASE WHEN entity_id = canonical_id THEN (SELECT max(x.k % 50 / 100.0e0) FROM g x WHERE x.canonical_id = g.canonical_id) ELSE k % 50 / 100.0e0 END AS confidence, entity_id = canonical_id AS is_active,
  CASE WHEN entity_id = canonical_id THEN n ELSE 1 END AS n_properties FROM g""")
def _(spark, d):
    e = _shared(spark, d)
    merged = resolve.merge(e.drop("mmsi", "icao"), resolve.closure(resolve.match_ids(e, ("mmsi", "icao"))))
    return merged.select("entity_id", "canonical_id", "name", "confidence", "is_active", F.size("properties").cast("long").alias("n_properties"))


@register("watch_screen", """
SELECT 'supplier-' || s_suppkey AS entity_id, c_custkey AS list_id, 100 AS score, s_suppkey % 5 = 0 AS id_match, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 1 THEN 'Aka ' || c_custkey ELSE c_name END AS matched, 'confirmed' AS risk
FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 < 2""")
def _(spark, d):
    k, ck = F.col("s_suppkey").cast("string"), F.col("c_custkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(k, 9, "0"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("AKA-"), k)).otherwise("zzzzzz")
    names = model.read(spark, d, "supplier").select(F.concat(F.lit("supplier-"), k).alias("entity_id"), name.alias("name"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("m-"), k)).alias("mmsi"), F.lit(None).cast("string").alias("imo"))
    listed = model.read(spark, d, "customer").select(F.col("c_custkey").alias("list_id"), F.col("c_name").alias("list_name"), F.concat(F.lit("Aka "), ck).alias("aliases"), F.concat(F.lit("M"), ck).alias("mmsi"), F.lit("").alias("imo"))
    return resolve.screen(names, resolve.read_list(listed))


@register("anomaly_iforest")
def _(spark, d):
    f = tracks.kinematic_features(model.tracks(spark, d))
    named = ["speed_z", "heading_jerk", "dwell_ratio", "hour_sin", "hour_cos", "centroid_km"]
    return forest.score(f, named, forest.fit_sample(f, named, "event_id")).select("entity_id", "event_id", F.round("score", 4).alias("score"))


@register("events_of_entity", "SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, d):
    e = model.read(spark, d, "events").withColumn("entity_id", F.col("user_id"))
    return store.events_of(e, 7, 20).select("event_id", "ts")


@register("entity_count", WITH_ENT + "SELECT count(*) AS n FROM ent WHERE entity_type = 'customer' AND is_active")
def _(spark, d):
    return store.count_entities(ents(spark, d), "Customer")


@register("entity_page_total", WITH_ENT + "SELECT entity_id, (SELECT count(*) FROM ent WHERE entity_type = 'part' AND is_active) AS total FROM ent WHERE entity_type = 'part' AND is_active ORDER BY name DESC, entity_id LIMIT 25 OFFSET 50")
def _(spark, d):
    return store.page(ents(spark, d), "part", 25, 50).select("entity_id", "total")


@register("entity_find", WITH_ENT + f"SELECT entity_id FROM ent WHERE entity_type = 'customer' AND {NEAR} <= 2000")
def _(spark, d):
    return store.find(ents(spark, d), near=(*AMSTERDAM, 2000.0), entity_type="customer").select("entity_id")


@register("entity_csv", "SELECT s_suppkey || ',\"' || replace(s_name || ', \"q\"', '\"', '\"\"') || '\",' AS value FROM supplier")
def _(spark, d):
    return store.as_csv(model.read(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "q"')).alias("name"), F.lit(None).cast("string").alias("none")))


@register("entity_json", "SELECT 'supplier-' || s_suppkey AS entity_id, '{\"entity_id\":\"supplier-' || s_suppkey || '\",\"name\":\"' || s_name || '\"}' AS value FROM supplier")
def _(spark, d):
    return store.as_json(model.entities(spark, d, ("supplier",)).select("entity_id", "name", F.lit(None).cast("string").alias("none")))


@register("events_kept", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def _(spark, d):
    t = model.tracks(spark, d).select("event_id", "ts")
    return store.expire(t, F.lit(t.agg(F.max("ts")).first()[0]), 10).select("event_id")


@register("source_status", """
WITH b AS (SELECT user_id, max(ts) AS l, sum(event_id % 3) AS events, sum(event_id % 4) AS errors FROM events WHERE user_id % 7 <> 0 GROUP BY 1), s AS (SELECT DISTINCT user_id FROM events)
SELECT s.user_id AS source_id, CAST(coalesce(events, 0) AS BIGINT) AS events, CAST(coalesce(errors, 0) AS BIGINT) AS errors, CASE WHEN s.user_id % 5 = 0 THEN 'disabled' WHEN l IS NULL THEN 'unknown' WHEN errors > events THEN 'error'
  WHEN floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(l)) > 86400 THEN 'stale' ELSE 'healthy' END AS status FROM s LEFT JOIN b USING (user_id)""")
def _(spark, d):
    e = model.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("source_id", F.col("user_id"))
    sources = e.select("source_id").distinct().withColumn("enabled", F.col("source_id") % 5 != 0)
    beats = e.where("source_id % 7 <> 0").select("source_id", "ts", (F.col("event_id") % 3).alias("events"), (F.col("event_id") % 4).alias("errors"))
    return store.source_status(sources, beats, F.lit(e.agg(F.max("ts")).first()[0]), 86_400).drop("last_seen")


RULES = [
    ("fast", True, "vessel", "threshold", "speed", ">=", 30.0, None, None, None, None),
    ("even", True, "*", "threshold", "bucket", "=", 4.0, None, None, None, None),
    ("zone", True, "Vessel", "geofence", None, None, None, 20.0, 10.0, 1500.0, None),
    ("lost", True, "vessel", "stale", None, None, None, None, None, None, 86_400),
    ("jump", True, "vessel", "speed_jump", None, None, 25.0, None, None, None, None),
    ("off", False, "*", "threshold", "speed", ">", 0.0, None, None, None, None),
    ("planes", True, "aircraft", "threshold", "speed", ">", 0.0, None, None, None, None),
]


@register("rule_monitor", T + f""", r AS (SELECT *, lag(speed) OVER w AS before, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS rn FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)), l AS (SELECT * FROM r WHERE rn = 1)
SELECT 'fast' AS rule_id, entity_id, 'threshold' AS kind, round(speed, 6) AS observed FROM l WHERE speed >= 30
UNION ALL SELECT 'even', entity_id, 'threshold', 4.0e0 FROM l WHERE entity_id % 6 = 4
UNION ALL SELECT 'zone', entity_id, 'geofence', round({hav('lat', 'lon', '20.0e0', '10.0e0')}, 6) FROM l WHERE {hav('lat', 'lon', '20.0e0', '10.0e0')} <= 1500
UNION ALL SELECT 'lost', entity_id, 'stale', floor(epoch((SELECT max(ts) FROM t))) - floor(epoch(ts)) FROM l WHERE floor(epoch((SELECT max(ts) FROM t))) - floor(epoch(ts)) > 86400
UNION ALL SELECT 'jump', entity_id, 'speed_jump', round(abs(speed - before), 6) FROM l WHERE abs(speed - before) > 25""")
def _(spark, d):
    t = model.tracks(spark, d)
    pair = tracks.latest(t, 2).groupBy("entity_id").agg(F.max(F.struct("ts", "event_id", "lat", "lon", "speed")).alias("l"), F.max(F.when(F.col("rank") == 2, F.col("speed"))).alias("previous_speed"))
    states = pair.select("entity_id", F.lit("vessel").alias("entity_type"), "l.lat", "l.lon", "l.ts", "previous_speed", "l.speed", F.create_map(F.lit("speed"), F.col("l.speed").cast("string"), F.lit("bucket"), (F.col("entity_id") % 6).cast("string")).alias("properties"))
    table = spark.createDataFrame(RULES, "rule_id string, enabled boolean, entity_type string, kind string, property string, op string, value double, lat double, lon double, radius_km double, seconds long")
    return rules.monitor(states, table, F.lit(t.agg(F.max("ts")).first()[0]))


@register("rule_fence_transitions", T + f", i AS (SELECT *, {hav('lat', 'lon', '0.0e0', '0.0e0')} <= 1700 AS x FROM t), l AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY entity_id ORDER BY ts, event_id), false) AS b FROM i) SELECT 'gulf' AS fence, entity_id, event_id, CASE WHEN x THEN 'enter' ELSE 'exit' END AS transition FROM l WHERE x <> b")
def _(spark, d):
    return rules.fence_transitions(model.tracks(spark, d), "gulf", 0.0, 0.0, 1700.0)


@register("threat_by_level", f"SELECT entity_id, score, level FROM ({THREAT}) WHERE level IN ('yellow', 'orange', 'red')")
def _(spark, d):
    return rules.by_level(_threat(spark, d), "yellow")


@register("threat_share", f"SELECT count(*) AS n, round(coalesce(count(*) FILTER (WHERE level IN ('orange', 'red')) * 100.0e0 / count(*), 0), 4) AS percent FROM ({THREAT})")
def _(spark, d):
    return rules.threat_share(_threat(spark, d))


@register("alerts_open", T + "SELECT event_id AS alert_id, entity_id FROM t WHERE speed >= 35 AND event_id % 4 <> 0")
def _(spark, d):
    alerts = model.tracks(spark, d).where("speed >= 35").select(F.col("event_id").alias("alert_id"), "entity_id", "ts")
    return rules.open_alerts(alerts, alerts.where("alert_id % 4 = 0").select("alert_id")).select("alert_id", "entity_id")


@register("stream_merged", T + "SELECT entity_id, event_type AS kind, arg_max(event_id, (ts, CAST(event_id AS VARCHAR))) AS last_event FROM t GROUP BY 1, 2")
def _(spark, d):
    log = model.tracks(spark, d).select("entity_id", "ts", F.create_map("event_type", F.col("event_id").cast("string")).alias("properties"))
    return streams.merged(log).select("entity_id", F.explode("properties").alias("kind", "v")).select("entity_id", "kind", F.col("v").cast("long").alias("last_event"))


@register("stream_outbox", "SELECT 'north' AS peer, event_id AS seq FROM events WHERE event_id > 9000 UNION ALL SELECT 'south', event_id FROM events")
def _(spark, d):
    acks = spark.createDataFrame([("north", 12), ("north", 9000), ("gone", 5)], "peer string, seq long")
    return streams.outbox(model.read(spark, d, "events").select(F.col("event_id").alias("seq")), acks, ["north", "south"]).select("peer", "seq")
