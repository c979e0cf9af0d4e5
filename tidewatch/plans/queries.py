"""Registered queries over the star-schema tables, each with its DuckDB twin."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Window, functions as F

from ..functions import geo
from ..operators import graph, ingest, rules, store, tracks
from ..sources import feeds
from ..streaming import streams
from . import model
from .ql import Engine

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ENT, REL, TRK = model.entity_sql(), model.relation_sql(), model.TRACK_SQL
EDGES2 = ("customer_nation", "supplier_nation", "in_region")
GRAPH_TYPES = ("customer", "supplier", "nation", "region")
ENTG, RELG = model.entity_sql(GRAPH_TYPES), model.relation_sql(EDGES2)
WITH_ENT = f"WITH ent AS ({ENT}) "
AMSTERDAM = (20.0, 10.0)
RING = [(-30.0, -60.0), (40.0, -50.0), (50.0, 40.0), (-20.0, 70.0)]
RING_WKT = "POLYGON((-60 -30, -50 40, 40 50, 70 -20, -60 -30))"


def hav(a, b, c, d, r=6371.0):
    return f"2 * {r}e0 * asin(least(1.0e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def poly(lat, lon, ring):
    out = []
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            out.append(f"(CASE WHEN ({y1}e0 > {lat}) <> ({y2}e0 > {lat}) AND {lon} < {x1}e0 + ({lat} - {y1}e0) * {(x2 - x1) / (y2 - y1)!r}e0 THEN 1 ELSE 0 END)")
    return f"(({' + '.join(out)}) % 2 = 1)"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def ql(name: str, text: str, sql: str, types=("customer", "supplier", "part"), edges=None):
    def run(spark, sf_dir):
        return Engine(model.entities(spark, sf_dir, types), model.relationships(spark, sf_dir, edges) if edges else None).run(text)

    QUERIES[name], ORACLE_SQL[name] = run, sql


NEAR = hav("lat", "lon", "20.0e0", "10.0e0")
ql("ql_filter", 'MATCH (s:Customer) WHERE s.acctbal > 5000 AND s.mktsegment = "BUILDING" RETURN s.id, s.name, s.acctbal', WITH_ENT + "SELECT entity_id AS id, name, acctbal FROM ent WHERE entity_type = 'customer' AND acctbal > 5000 AND mktsegment = 'BUILDING'")
ql("ql_near", "MATCH (s:customer) WHERE s.acctbal > 0 AND NEAR(s, lat=20.0, lon=10.0, radius_km=4000) RETURN s.id, s.name, s.acctbal ORDER BY s.acctbal DESC, s.id LIMIT 10", WITH_ENT + f"SELECT entity_id AS id, name, acctbal FROM ent WHERE entity_type = 'customer' AND acctbal > 0 AND {NEAR} <= 4000 ORDER BY acctbal DESC, entity_id LIMIT 10")
ql("ql_within", "MATCH (p:part) WHERE WITHIN(p, min_lat=-10, min_lon=-20, max_lat=30, max_lon=40) RETURN p.id, p.lat, p.lon", WITH_ENT + "SELECT entity_id AS id, lat, lon FROM ent WHERE entity_type = 'part' AND lat BETWEEN -10 AND 30 AND lon BETWEEN -20 AND 40")
ql("ql_polygon", f'MATCH (c:customer) WHERE WITHIN(c, polygon="{RING_WKT}") RETURN c.id', WITH_ENT + f"SELECT entity_id AS id FROM ent WHERE entity_type = 'customer' AND {poly('lat', 'lon', RING)}")
ql("ql_distance_topk", "MATCH (c:customer) RETURN c.id, ROUND(DISTANCE(c, lat=20.0, lon=10.0), 3) AS km ORDER BY km, c.id LIMIT 20", WITH_ENT + f"SELECT entity_id AS id, round({NEAR}, 3) AS km FROM ent WHERE entity_type = 'customer' ORDER BY km, id LIMIT 20")
ql("ql_like", 'MATCH (c:customer) WHERE c.name LIKE "%00001%" RETURN c.id, c.name', WITH_ENT + "SELECT entity_id AS id, name FROM ent WHERE entity_type = 'customer' AND name LIKE '%00001%'")
ql("ql_or_not", 'MATCH (c:customer) WHERE (c.acctbal < 0 OR c.acctbal > 9000) AND NOT c.mktsegment = "MACHINERY" RETURN c.id', WITH_ENT + "SELECT entity_id AS id FROM ent WHERE entity_type = 'customer' AND (acctbal < 0 OR acctbal > 9000) AND NOT mktsegment = 'MACHINERY'")
ql("ql_in_list", 'MATCH (c:customer) WHERE c.mktsegment IN ["BUILDING", "AUTOMOBILE"] AND c.nationkey NOT IN [1, 2, 3] RETURN c.id, c.nationkey', WITH_ENT + "SELECT entity_id AS id, nationkey FROM ent WHERE entity_type = 'customer' AND mktsegment IN ('BUILDING', 'AUTOMOBILE') AND nationkey NOT IN (1, 2, 3)")
ql("ql_between", "MATCH (p:part) WHERE p.size BETWEEN 10 AND 20 RETURN p.id, p.size", WITH_ENT + "SELECT entity_id AS id, size FROM ent WHERE entity_type = 'part' AND size BETWEEN 10 AND 20")
ql("ql_is_null", "MATCH (x) WHERE x.acctbal IS NULL AND x.size IS NOT NULL RETURN x.id, x.type", WITH_ENT + "SELECT entity_id AS id, entity_type AS type FROM ent WHERE acctbal IS NULL AND size IS NOT NULL")
ql("ql_contains", 'MATCH (s) WHERE s.name CONTAINS "1" AND s.id STARTS WITH "supplier" RETURN s.id', WITH_ENT + "SELECT entity_id AS id FROM ent WHERE contains(name, '1') AND starts_with(entity_id, 'supplier')")
ql("ql_inline_props", 'MATCH (c:customer {mktsegment: "BUILDING", nationkey: 5}) RETURN c.id', WITH_ENT + "SELECT entity_id AS id FROM ent WHERE entity_type = 'customer' AND mktsegment = 'BUILDING' AND nationkey = 5")
ql("ql_any_type", "MATCH (x) WHERE x.confidence >= 0.95 RETURN x.id, x.type", WITH_ENT + "SELECT entity_id AS id, entity_type AS type FROM ent WHERE confidence >= 0.95e0")
ql("ql_arithmetic", "MATCH (p:part) WHERE p.retailprice * 2 - p.size > 1900 RETURN p.id, ROUND(p.retailprice / 2 + 1, 4) AS half, p.brand + '/' + p.size AS label, p.size / 0 AS nothing", WITH_ENT + "SELECT entity_id AS id, round(retailprice / 2 + 1, 4) AS half, brand || '/' || size AS label, CAST(NULL AS DOUBLE) AS nothing FROM ent WHERE entity_type = 'part' AND retailprice * 2 - size > 1900")
ql("ql_distinct", "MATCH (c:customer) RETURN DISTINCT c.mktsegment, c.nationkey", WITH_ENT + "SELECT DISTINCT mktsegment, nationkey FROM ent WHERE entity_type = 'customer'")
ql("ql_count", "MATCH (c:customer) WHERE c.acctbal > 0 RETURN COUNT(*) AS n", WITH_ENT + "SELECT count(*) AS n FROM ent WHERE entity_type = 'customer' AND acctbal > 0")
ql("ql_agg_global", "MATCH (c:customer) RETURN COUNT(c) AS n, ROUND(SUM(c.acctbal), 2) AS total, ROUND(AVG(c.acctbal), 4) AS mean, MIN(c.acctbal) AS low, MAX(c.acctbal) AS high", WITH_ENT + "SELECT count(*) AS n, round(sum(acctbal), 2) AS total, round(avg(acctbal), 4) AS mean, min(acctbal) AS low, max(acctbal) AS high FROM ent WHERE entity_type = 'customer'")
ql("ql_group_by", "MATCH (c:customer) RETURN c.mktsegment, COUNT(*) AS n, MAX(c.acctbal) AS top ORDER BY n DESC, c.mktsegment", WITH_ENT + "SELECT mktsegment, count(*) AS n, max(acctbal) AS top FROM ent WHERE entity_type = 'customer' GROUP BY 1")
ql("ql_having", "MATCH (c:customer) RETURN c.nationkey, COUNT(*) AS n GROUP BY c.nationkey HAVING COUNT(*) > 60", WITH_ENT + "SELECT nationkey, count(*) AS n FROM ent WHERE entity_type = 'customer' GROUP BY 1 HAVING count(*) > 60")
ql("ql_count_distinct", "MATCH (x) RETURN x.type, COUNT(DISTINCT x.nationkey) AS n", WITH_ENT + "SELECT entity_type AS type, count(DISTINCT nationkey) AS n FROM ent GROUP BY 1")
ql("ql_collect", "MATCH (c:customer) WHERE c.acctbal > 9500 RETURN c.nationkey, COLLECT(c.id) AS ids", WITH_ENT + "SELECT nationkey, list_sort(list(entity_id)) AS ids FROM ent WHERE entity_type = 'customer' AND acctbal > 9500 GROUP BY 1")
ql("ql_case_sum", "MATCH (c:customer) RETURN c.mktsegment, SUM(CASE WHEN c.acctbal < 0 THEN 1 ELSE 0 END) AS overdrawn", WITH_ENT + "SELECT mktsegment, CAST(sum(CASE WHEN acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS overdrawn FROM ent WHERE entity_type = 'customer' GROUP BY 1")
G = f"WITH ent AS ({ENTG}), rel AS ({RELG}) "
ql("ql_hop1", "MATCH (c:customer)-[:customer_nation]->(n:nation) WHERE c.acctbal > 9000 RETURN c.id, n.name", G + "SELECT c.entity_id AS id, n.name FROM ent c JOIN rel r ON r.source_id = c.entity_id AND r.rel_type = 'customer_nation' JOIN ent n ON n.entity_id = r.target_id AND n.entity_type = 'nation' WHERE c.entity_type = 'customer' AND c.acctbal > 9000", GRAPH_TYPES, EDGES2)
ql("ql_hop2", "MATCH (c:customer)-[:customer_nation]->(n:nation)-[:in_region]->(r:region) RETURN r.name, COUNT(*) AS n", G + "SELECT r.name, count(*) AS n FROM ent c JOIN rel a ON a.source_id = c.entity_id AND a.rel_type = 'customer_nation' JOIN rel b ON b.source_id = a.target_id AND b.rel_type = 'in_region' JOIN ent r ON r.entity_id = b.target_id WHERE c.entity_type = 'customer' GROUP BY 1", GRAPH_TYPES, EDGES2)
ql("ql_hop3_mixed_dir", "MATCH (c:customer)-[:customer_nation]->(n:nation)<-[:supplier_nation]-(s:supplier) WHERE c.acctbal > 9800 RETURN c.id AS c_id, s.id AS s_id", G + "SELECT c.entity_id AS c_id, b.source_id AS s_id FROM ent c JOIN rel a ON a.source_id = c.entity_id AND a.rel_type = 'customer_nation' JOIN rel b ON b.target_id = a.target_id AND b.rel_type = 'supplier_nation' WHERE c.entity_type = 'customer' AND c.acctbal > 9800", GRAPH_TYPES, EDGES2)
ql("ql_optional", "MATCH (n:nation) OPTIONAL MATCH (n)<-[:supplier_nation]-(s:supplier) RETURN n.name, COUNT(s) AS suppliers", G + "SELECT n.name, count(r.source_id) AS suppliers FROM ent n LEFT JOIN rel r ON r.target_id = n.entity_id AND r.rel_type = 'supplier_nation' WHERE n.entity_type = 'nation' GROUP BY 1", GRAPH_TYPES, EDGES2)
ql("ql_not_exists", "MATCH (n:nation) WHERE NOT EXISTS { (n)<-[:supplier_nation]-(s:supplier {nationkey: 3}) } RETURN n.id", G + "SELECT entity_id AS id FROM ent n WHERE entity_type = 'nation' AND NOT EXISTS (SELECT 1 FROM rel r JOIN ent s ON s.entity_id = r.source_id AND s.nationkey = 3 WHERE r.target_id = n.entity_id AND r.rel_type = 'supplier_nation')", GRAPH_TYPES, EDGES2)
ql("ql_exists", "MATCH (n:nation) WHERE EXISTS { (n)<-[:supplier_nation]-(s:supplier) } AND n.lat > 0 RETURN n.id", G + "SELECT entity_id AS id FROM ent n WHERE entity_type = 'nation' AND lat > 0 AND EXISTS (SELECT 1 FROM rel r WHERE r.target_id = n.entity_id AND r.rel_type = 'supplier_nation')", GRAPH_TYPES, EDGES2)
ql("ql_with_stage", "MATCH (c:customer)-[:customer_nation]->(n:nation) WITH n, COUNT(*) AS k, ROUND(SUM(c.acctbal), 2) AS total WHERE k > 50 RETURN n.name, k, total ORDER BY k DESC", G + "SELECT n.name, count(*) AS k, round(sum(c.acctbal), 2) AS total FROM ent c JOIN rel r ON r.source_id = c.entity_id AND r.rel_type = 'customer_nation' JOIN ent n ON n.entity_id = r.target_id WHERE c.entity_type = 'customer' GROUP BY n.name HAVING count(*) > 50", GRAPH_TYPES, EDGES2)
ql("ql_undirected", "MATCH (n:nation)-[:in_region]-(r:region) RETURN r.name, COUNT(*) AS n", G + "SELECT r.name, count(*) AS n FROM ent r JOIN rel e ON e.target_id = r.entity_id AND e.rel_type = 'in_region' WHERE r.entity_type = 'region' GROUP BY 1", GRAPH_TYPES, EDGES2)
ql("ql_theta_near", "MATCH (s:supplier), (n:nation) WHERE NEAR(s, n, radius_km=800) RETURN s.id AS s_id, n.id AS n_id", G + f"SELECT s.entity_id AS s_id, n.entity_id AS n_id FROM ent s, ent n WHERE s.entity_type = 'supplier' AND n.entity_type = 'nation' AND {hav('s.lat', 's.lon', 'n.lat', 'n.lon')} <= 800", GRAPH_TYPES, EDGES2)


def ents(spark, sf_dir):
    return model.entities(spark, sf_dir)


@register("entity_get", WITH_ENT + "SELECT entity_id, name, lat, lon FROM ent WHERE entity_id = 'customer-42'")
def _(spark, d):
    return store.get_entity(ents(spark, d), "customer-42").select("entity_id", "name", "lat", "lon")


@register("entity_search", WITH_ENT + "SELECT entity_id, name FROM ent WHERE contains(lower(name), 'er#00000007') OR contains(lower(entity_id), 'er#00000007')")
def _(spark, d):
    return store.search(ents(spark, d), "er#00000007").select("entity_id", "name")


@register("entity_page", WITH_ENT + "SELECT entity_id, name FROM ent WHERE entity_type = 'customer' AND is_active ORDER BY name DESC, entity_id LIMIT 50 OFFSET 100")
def _(spark, d):
    return store.by_type(ents(spark, d), "CUSTOMER", 50, 100).select("entity_id", "name")


@register("entity_radius", WITH_ENT + f"SELECT entity_id FROM ent WHERE {NEAR} <= 1500")
def _(spark, d):
    return store.in_radius(ents(spark, d), *AMSTERDAM, 1500).select("entity_id")


@register("entity_stats", f"SELECT 'entities' AS table_name, count(*) AS n FROM ({ENT}) UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'relationships', count(*) FROM ({RELG})")
def _(spark, d):
    return store.stats(entities=ents(spark, d), events=model.read(spark, d, "events"), relationships=model.relationships(spark, d, EDGES2))


@register("entity_upsert", WITH_ENT + "SELECT entity_id, CASE WHEN entity_type = 'supplier' THEN 'renamed' ELSE name END AS name FROM ent WHERE entity_type IN ('customer', 'supplier')")
def _(spark, d):
    now = ents(spark, d).where("entity_type in ('customer', 'supplier')").select("entity_id", "name", F.lit(1).alias("last_updated"))
    new = now.where(F.col("entity_id").startswith("supplier")).select("entity_id", F.lit("renamed").alias("name"), F.lit(2).alias("last_updated"))
    return store.upsert(now, new).select("entity_id", "name")


@register("entity_geojson", WITH_ENT + "SELECT entity_id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || lon || ',' || lat || ']},\"properties\":{\"entity_id\":\"' || entity_id || '\",\"entity_type\":\"' || entity_type || '\"}}' AS feature FROM ent WHERE entity_type = 'supplier'")
def _(spark, d):
    return store.geojson(ents(spark, d).where("entity_type = 'supplier'").select("entity_id", "entity_type", "lat", "lon"))


@register("soft_delete", WITH_ENT + "SELECT entity_id, is_active AND nationkey IS DISTINCT FROM 3 AS is_active FROM ent")
def _(spark, d):
    e = ents(spark, d)
    return store.soft_delete(e, e.where("nationkey = 3")).select("entity_id", "is_active")


@register("events_range", f"SELECT event_id, entity_id FROM ({TRK}) WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07 12:00:00'")
def _(spark, d):
    return store.events_in(model.tracks(spark, d), "2024-01-05", "2024-01-07 12:00:00").select("event_id", "entity_id")


@register("events_region", f"SELECT event_id FROM ({TRK}) WHERE entity_id IN (SELECT entity_id FROM ({TRK}) GROUP BY entity_id HAVING max(lat) > 20) AND ts >= TIMESTAMP '2024-01-20'")
def _(spark, d):
    t = model.tracks(spark, d)
    ids = t.groupBy("entity_id").agg(F.max("lat").alias("m")).where("m > 20").select("entity_id")
    return store.events_in(t, start="2024-01-20", entity_ids=ids).select("event_id")


@register("events_global", f"SELECT event_id, ts FROM ({TRK}) WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def _(spark, d):
    return store.events_in(model.tracks(spark, d), event_type="click").orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "ts")


@register("events_idempotent", "SELECT count(*) AS n FROM events")
def _(spark, d):
    e = model.tracks(spark, d)
    return store.insert_events(e, e.where("event_id % 3 = 0")).agg(F.count("*").alias("n"))


@register("props_latest", f"SELECT entity_id, event_type AS key, max_by(value, (ts, event_id)) AS value FROM ({TRK}) GROUP BY 1, 2")
def _(spark, d):
    h = model.tracks(spark, d).select("entity_id", F.col("event_type").alias("key"), F.struct("ts", "event_id").alias("ts"), "value")
    return store.latest_properties(h).select("entity_id", "key", "value")


def _history(spark, d):
    """Points of tracks as states of vessels, and an engine whose now is the last of them."""
    t = model.tracks(spark, d).withColumn("entity_type", F.lit("vessel")).select("entity_id", "ts", "event_id", "entity_type", "lat", "lon", "speed")
    return Engine(t, history=t, now=t.agg(F.max("ts")).first()[0])


@register("ql_as_of", f"SELECT entity_id, max_by(speed, (ts, event_id)) AS speed FROM ({TRK}) WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def _(spark, d):
    return _history(spark, d).run('MATCH (v:vessel) AT TIME timestamp("2024-01-15T00:00:00") RETURN v.id AS entity_id, v.speed')


@register("ql_since", f"SELECT entity_id, count(*) AS n FROM ({TRK}) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOUR GROUP BY 1")
def _(spark, d):
    return _history(spark, d).run("MATCH (v:vessel) RETURN v.id AS entity_id, COUNT(*) AS n SINCE now() - interval(72, hours)")


ql("ql_exists_or", "MATCH (n:nation) WHERE n.lat > 60 OR NOT EXISTS { (n)<-[:supplier_nation]-(s:supplier {nationkey: 3}) } AND n.lon > 0 RETURN n.id", G + "SELECT entity_id AS id FROM ent n WHERE entity_type = 'nation' AND (lat > 60 OR (lon > 0 AND NOT EXISTS (SELECT 1 FROM rel r JOIN ent s ON s.entity_id = r.source_id AND s.nationkey = 3 WHERE r.target_id = n.entity_id AND r.rel_type = 'supplier_nation')))", GRAPH_TYPES, EDGES2)


@register("rel_in_out", f"WITH rel AS ({RELG}) SELECT source_id, target_id, rel_type FROM rel WHERE source_id = 'nation-7' OR target_id = 'nation-7'")
def _(spark, d):
    return store.edges_of(model.relationships(spark, d, EDGES2), "nation-7")


REL3 = ("placed_by", "contains", "supplied_by")
RELO = model.relation_sql(REL3)


@register("graph_degree", f"WITH rel AS ({RELO}) SELECT entity_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source_id AS entity_id, 1 AS o, 0 AS i FROM rel UNION ALL SELECT target_id, 0, 1 FROM rel) GROUP BY 1")
def _(spark, d):
    return graph.degrees(model.relationships(spark, d, REL3))


def _both(spark, d):
    e = model.relationships(spark, d, EDGES2)
    return e.unionByName(e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.concat(F.lit("of_"), "rel_type").alias("rel_type")))


BOTH = f"rel AS (SELECT * FROM ({RELG}) UNION ALL SELECT target_id, source_id, 'of_' || rel_type FROM ({RELG}))"


@register("graph_neighbors", f"WITH RECURSIVE {BOTH}, w(entity_id, depth) AS (SELECT 'region-1', 0 UNION SELECT r.target_id, w.depth + 1 FROM w JOIN rel r ON r.source_id = w.entity_id WHERE w.depth < 3), f AS (SELECT entity_id, min(depth) AS depth FROM w GROUP BY 1) SELECT f.entity_id, f.depth, min(r.rel_type) AS via FROM f JOIN rel r ON r.target_id = f.entity_id JOIN f g ON g.entity_id = r.source_id AND g.depth = f.depth - 1 WHERE f.depth > 0 GROUP BY 1, 2")
def _(spark, d):
    return graph.neighbors(_both(spark, d), "region-1", 3)


@register("graph_multihop", f"WITH RECURSIVE {BOTH}, w(entity_id, depth) AS (SELECT target_id, 1 FROM rel WHERE source_id = 'nation-3' UNION SELECT r.target_id, w.depth + 1 FROM w JOIN rel r ON r.source_id = w.entity_id WHERE w.depth < 3) SELECT DISTINCT entity_id, depth FROM w")
def _(spark, d):
    return graph.hops(_both(spark, d), "nation-3", 3)


_PATHS = f"WITH RECURSIVE {BOTH}, e AS (SELECT DISTINCT source_id, target_id FROM rel), w(nodes, cur, hops) AS (SELECT [source_id, target_id], target_id, 1 FROM e WHERE source_id = 'supplier-1' UNION ALL SELECT list_append(w.nodes, e.target_id), e.target_id, w.hops + 1 FROM w JOIN e ON e.source_id = w.cur WHERE w.hops < 4 AND w.cur <> 'region-0' AND NOT list_contains(w.nodes, e.target_id)) SELECT hops, array_to_string(nodes, '>') AS nodes FROM w WHERE cur = 'region-0'"


def _small(spark, d):
    """Supplier and region edges only, so that path enumeration stays small."""
    return _both(spark, d)


@register("graph_paths", _PATHS.replace("w.hops < 4", "w.hops < 3"))
def _(spark, d):
    return graph.simple_paths(_small(spark, d), "supplier-1", "region-0", 3)


@register("graph_shortest", f"WITH RECURSIVE {BOTH}, e AS (SELECT DISTINCT source_id, target_id FROM rel), w(nodes, cur, hops) AS (SELECT [source_id, target_id], target_id, 1 FROM e WHERE source_id = 'customer-1' UNION ALL SELECT list_append(w.nodes, e.target_id), e.target_id, w.hops + 1 FROM w JOIN e ON e.source_id = w.cur WHERE w.hops < 4 AND w.cur <> 'region-4' AND NOT list_contains(w.nodes, e.target_id)) SELECT hops, array_to_string(nodes, '>') AS nodes FROM w WHERE cur = 'region-4' ORDER BY hops, nodes LIMIT 1")
def _(spark, d):
    return graph.shortest_path(_both(spark, d), "customer-1", "region-4", 4)


@register("graph_edge_match", f"WITH ent AS ({ENTG}), rel AS ({RELG}) SELECT source_id, rel_type, target_id, s.name AS source_name, t.name AS target_name FROM rel JOIN ent s ON s.entity_id = source_id JOIN ent t ON t.entity_id = target_id WHERE rel_type = 'supplier_nation'")
def _(spark, d):
    e = model.relationships(spark, d, ("supplier_nation",))
    n = model.entities(spark, d, GRAPH_TYPES).select("entity_id", "name")
    return e.join(n.toDF("source_id", "source_name"), "source_id").join(n.toDF("target_id", "target_name"), "target_id").select("source_id", "rel_type", "target_id", "source_name", "target_name")


B = "(degrees(atan2(sin(radians(10.0e0 - lon)) * cos(radians(20.0e0)), cos(radians(lat)) * sin(radians(20.0e0)) - sin(radians(lat)) * cos(radians(20.0e0)) * cos(radians(10.0e0 - lon)))) + 360) % 360"


@register("geo_bearing", WITH_ENT + f"SELECT entity_id, round({B}, 4) AS bearing FROM ent WHERE entity_type = 'supplier'")
def _(spark, d):
    return ents(spark, d).where("entity_type = 'supplier'").select("entity_id", F.round(geo.bearing(F.col("lat"), F.col("lon"), *AMSTERDAM), 4).alias("bearing"))


@register("geo_destination", WITH_ENT + "SELECT entity_id, round(degrees(asin(sin(radians(lat)) * cos(100 / 6371.0e0) + cos(radians(lat)) * sin(100 / 6371.0e0) * cos(radians(45.0e0)))), 4) + 0.0 AS lat2, round(lon + degrees(atan2(sin(radians(45.0e0)) * sin(100 / 6371.0e0) * cos(radians(lat)), cos(100 / 6371.0e0) - sin(radians(lat)) * (sin(radians(lat)) * cos(100 / 6371.0e0) + cos(radians(lat)) * sin(100 / 6371.0e0) * cos(radians(45.0e0))))), 4) + 0.0 AS lon2 FROM ent WHERE entity_type = 'supplier'")
def _(spark, d):
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), 45.0, 100.0)
    return ents(spark, d).where("entity_type = 'supplier'").select("entity_id", (F.round(lat, 4) + 0.0).alias("lat2"), (F.round(lon, 4) + 0.0).alias("lon2"))


T = f"WITH t AS ({TRK}) "


@register("track_latest_n", T + "SELECT entity_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS rank FROM t) WHERE rank <= 5")
def _(spark, d):
    return tracks.latest(model.tracks(spark, d), 5).select("entity_id", "event_id", "rank")


@register("track_manoeuvre", T + ", h AS (SELECT t.* FROM t JOIN (SELECT entity_id, max(ts) AS e FROM t GROUP BY 1) x USING (entity_id) WHERE ts >= e - INTERVAL 3 DAY), g AS (SELECT entity_id, min_by(speed, (ts, event_id)) AS s0, max_by(speed, (ts, event_id)) AS s1, min_by(course, (ts, event_id)) AS c0, max_by(course, (ts, event_id)) AS c1 FROM h GROUP BY 1 HAVING count(*) >= 2), q AS (SELECT entity_id, CASE WHEN s0 > 0.1 THEN abs(s1 - s0) / s0 * 100 ELSE 0 END AS sc, least(abs(c0 - c1) % 360, 360 - abs(c0 - c1) % 360) AS cc FROM g) SELECT entity_id, round(sc, 4) AS speed_change, round(cc, 4) AS course_change, sc > 50 OR cc > 30 AS manoeuvre FROM q")
def _(spark, d):
    return tracks.manoeuvres(model.tracks(spark, d))


ZONE = [(-20.0, -30.0), (20.0, -30.0), (20.0, 30.0), (-20.05, 30.0)]


@register("track_zone_events", T + f", i AS (SELECT *, {poly('lat', 'lon', ZONE)} AS inside FROM t), l AS (SELECT *, coalesce(lag(inside) OVER (PARTITION BY entity_id ORDER BY ts, event_id), false) AS b FROM i) SELECT entity_id, event_id, CASE WHEN inside THEN 'enter' ELSE 'exit' END AS transition FROM l WHERE inside <> b")
def _(spark, d):
    return tracks.zone_events(model.tracks(spark, d), ZONE)


@register("track_dwell", T + f", l AS (SELECT entity_id, max_by(lat, (ts, event_id)) AS la, max_by(lon, (ts, event_id)) AS lo FROM t GROUP BY 1), r AS (SELECT t.*, {hav('lat', 'lon', 'la', 'lo')} > 9 AS o FROM t JOIN l USING (entity_id)), x AS (SELECT entity_id, max(CASE WHEN o THEN ts END) AS lo FROM r GROUP BY 1), g AS (SELECT entity_id, CAST(epoch(max(ts)::TIMESTAMP(0)) - epoch(min(ts)::TIMESTAMP(0)) AS BIGINT) AS seconds FROM r JOIN x USING (entity_id) WHERE x.lo IS NULL OR ts > x.lo GROUP BY 1) SELECT * FROM g WHERE seconds >= 1200".replace("epoch(max(ts)::TIMESTAMP(0)) - epoch(min(ts)::TIMESTAMP(0))", "floor(epoch(max(ts))) - floor(epoch(min(ts)))"))
def _(spark, d):
    return tracks.dwell(model.tracks(spark, d), 9.0, 1200)


@register("track_pattern_of_life", T + ", h AS (SELECT entity_id, hour(ts) AS hour, count(*) AS n FROM t GROUP BY 1, 2), a AS (SELECT entity_id, list_sort(list(hour)) AS hours FROM h JOIN (SELECT entity_id, max(n) AS p FROM h GROUP BY 1) USING (entity_id) WHERE n > 0.5 * p GROUP BY 1) SELECT entity_id, count(*) AS n, round(avg(speed) + 1e-9, 3) AS mean_speed, round(stddev_pop(speed) + 1e-9, 3) AS std_speed, min(lat) AS min_lat, max(lon) AS max_lon, any_value(a.hours) AS hours FROM t JOIN a USING (entity_id) GROUP BY 1")
def _(spark, d):
    return tracks.pattern_of_life(model.tracks(spark, d)).select("entity_id", "n", F.round(F.col("mean_speed") + 1e-9, 3).alias("mean_speed"), F.round(F.col("std_speed") + 1e-9, 3).alias("std_speed"), "min_lat", "max_lon", F.col("hours").cast("array<bigint>").alias("hours"))


@register("track_anomaly")
def _(spark, d):
    return tracks.anomaly_scores(model.tracks(spark, d))


@register("track_dark", T + ", g AS (SELECT entity_id, CAST(floor((floor(epoch((SELECT max(ts) FROM t))) - floor(epoch(max(ts)))) / 60) AS BIGINT) AS minutes FROM t GROUP BY 1) SELECT entity_id, minutes, CASE WHEN minutes < 60 THEN 'low' WHEN minutes < 360 THEN 'medium' ELSE 'high' END AS severity FROM g WHERE minutes >= 30")
def _(spark, d):
    t = model.tracks(spark, d)
    now = t.agg(F.max("ts").alias("now")).first()["now"]
    return tracks.dark_targets(t, F.lit(now))


def project_sql(a, b, speed, course, minutes):
    far = f"({speed} * 1.852e0 * {minutes} / 60.0e0 / 6371.0e0)"
    lat = f"asin(sin(radians({a})) * cos({far}) + cos(radians({a})) * sin({far}) * cos(radians({course})))"
    return f"degrees({lat})", f"degrees(radians({b}) + atan2(sin(radians({course})) * sin({far}) * cos(radians({a})), cos({far}) - sin(radians({a})) * sin({lat})))"


_A, _B = project_sql("a.lat", "a.lon", "a.speed", "a.course", "t"), project_sql("b.lat", "b.lon", "b.speed", "b.course", "t")


@register("track_cpa", T + f""", l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1),
p AS (SELECT a.entity_id AS a, b.entity_id AS b, t, {_A[0]} AS la, {_A[1]} AS lo, {_B[0]} AS lb, {_B[1]} AS mb FROM l a JOIN l b ON a.entity_id < b.entity_id AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= (300 + (a.speed + b.speed) / 2) * 1.86, (SELECT unnest(range(61)) / 2.0e0 AS t)),
d AS (SELECT a, b, t, round({hav('la', 'lo', 'lb', 'mb')} / 1.852e0, 4) AS nm FROM p)
SELECT a, b, min(nm) AS dcpa_nm, arg_min(t, (nm, t)) AS tcpa_min FROM d GROUP BY 1, 2 HAVING min(nm) < 300 AND arg_min(t, (nm, t)) > 0""")
def _(spark, d):
    found = tracks.closest_approach(tracks.latest(model.tracks(spark, d), 1), 30, 300.0, risk_only=True)
    return found.select("a", "b", "dcpa_nm", "tcpa_min")


def bearing_sql(a, b, c, d):
    return f"(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360) % 360"


_LAGS = ", ".join(f"lag(lat, {k}) OVER o AS la{k}, lag(lon, {k}) OVER o AS lo{k}" for k in (1, 2, 3, 4))
_DWELL = " + ".join(f"CASE WHEN {hav('lat', 'lon', f'la{k}', f'lo{k}')} < 0.2 THEN 1 ELSE 0 END" for k in (1, 2, 3, 4))
_TURN = "least(abs(pw - way) % 360, 360 - abs(pw - way) % 360)"
FEATURES_SQL = T + f""", a AS (SELECT *, {_LAGS} FROM t WINDOW o AS (PARTITION BY entity_id ORDER BY ts, event_id)),
b AS (SELECT *, {bearing_sql('la1', 'lo1', 'lat', 'lon')} AS way FROM a),
c AS (SELECT *, lag(way) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS pw FROM b),
w AS (SELECT *, count(*) OVER x AS n, avg(speed) OVER x AS m, stddev_pop(speed) OVER x AS s, avg(lat) OVER x AS cla, avg(lon) OVER x AS clo,
  avg({_TURN}) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS jerk
  FROM c WINDOW x AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))
SELECT entity_id, event_id, round({hav('lat', 'lon', 'cla', 'clo')}, 4) + 0.0 AS centroid_km, round(CASE WHEN s > 1e-6 THEN (speed - m) / s ELSE 0 END, 4) + 0.0 AS speed_z,
  round(jerk, 4) + 0.0 AS heading_jerk, ({_DWELL}) / 4.0e0 AS dwell_ratio, round(sin(hour(ts) * pi() / 12), 4) + 0.0 AS hour_sin, round(cos(hour(ts) * pi() / 12), 4) + 0.0 AS hour_cos FROM w WHERE n >= 5"""


@register("track_features", FEATURES_SQL)
def _(spark, d):
    return tracks.kinematic_features(model.tracks(spark, d))


@register("rule_threshold", T + "SELECT 'fast' AS rule, entity_id, speed AS observed FROM t WHERE speed >= 38.5")
def _(spark, d):
    return rules.threshold_alerts(model.tracks(spark, d), "fast", "speed >= 38.5")


@register("rule_geofence", WITH_ENT + f"SELECT 'fence' AS rule, entity_id FROM ent WHERE {NEAR} <= 2500")
def _(spark, d):
    return rules.geofence_alerts(ents(spark, d), "fence", *AMSTERDAM, 2500)


@register("rule_stale", T + ", g AS (SELECT entity_id, CAST(floor(epoch((SELECT max(ts) FROM t))) - floor(epoch(max(ts))) AS BIGINT) AS age_s FROM t GROUP BY 1) SELECT * FROM g WHERE age_s > 7200")
def _(spark, d):
    t = model.tracks(spark, d)
    return rules.stale_alerts(t, F.lit(t.agg(F.max("ts").alias("now")).first()["now"]), 7200)


@register("rule_speed_anomaly", T + "SELECT entity_id, event_id, round(j, 6) AS jump FROM (SELECT *, abs(speed - lag(speed) OVER (PARTITION BY entity_id ORDER BY ts, event_id)) AS j FROM t) WHERE j > 30")
def _(spark, d):
    return rules.speed_jumps(model.tracks(spark, d), 30.0)


def greedy_sql(rows, key, seconds):
    """Per key the first row, and then each first one at least `seconds` after the one before."""
    same = " AND ".join(f"f.{k} = a.{k}" for k in key)
    keys = ", ".join(key)
    return f"""WITH RECURSIVE f AS ({rows}), a AS (
  (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) = 1)
  UNION ALL (SELECT f.* FROM a JOIN f ON {same} AND f.ts >= a.ts + INTERVAL {seconds} SECOND QUALIFY row_number() OVER (PARTITION BY {', '.join('f.' + k for k in key)} ORDER BY f.ts, f.event_id) = 1))
SELECT event_id FROM a"""


@register("dedup_window", greedy_sql(f"SELECT event_id, entity_id, event_type, ts FROM ({TRK})", ["entity_id", "event_type"], 86_400))
def _(spark, d):
    return rules.anchored_dedup(model.tracks(spark, d).select("event_id", "entity_id", "ts", "event_type"), ["entity_id", "event_type"], 86_400).select("event_id")


@register("rule_cooldown", greedy_sql(f"SELECT event_id, entity_id, ts FROM ({TRK}) WHERE speed >= 30", ["entity_id"], 6 * 3600))
def _(spark, d):
    fast = model.tracks(spark, d).where("speed >= 30").select("event_id", "entity_id", "ts")
    return rules.anchored_dedup(fast, ["entity_id"], 6 * 3600).select("event_id")


SITES = [("a", 20.0, 10.0, 500.0), ("b", -10.0, 30.0, 800.0)]
_NEAR = " , ".join(f"CASE WHEN d{i} <= {r} THEN 100.0 WHEN d{i} <= {2 * r} THEN ({2 * r} - d{i}) / {r} * 100 ELSE 0.0 END" for i, (_, _, _, r) in enumerate(SITES))
THREAT = T + f", l AS (SELECT entity_id, max_by(lat, (ts, event_id)) AS lat, max_by(lon, (ts, event_id)) AS lon, max_by(speed, (ts, event_id)) AS speed, max(ts) AS last_seen, entity_id % 17 = 0 AS sanctioned, CAST(entity_id % 101 AS DOUBLE) AS anomaly FROM t GROUP BY entity_id), m AS (SELECT *, {', '.join(f'{hav('lat', 'lon', f'{la}e0', f'{lo}e0')} AS d{i}' for i, (_, la, lo, _) in enumerate(SITES))}, least(greatest((floor(epoch((SELECT max(ts) FROM t))) - floor(epoch(last_seen))) / 60 / 1440 * 100, 0), 100) AS dark FROM l), s AS (SELECT entity_id, round(least(greatest(0.35 * CASE WHEN sanctioned THEN 100.0 ELSE 0.0 END + 0.25 * anomaly + 0.20 * greatest(0.0, {_NEAR}) + 0.12 * dark + 0.08 * least(greatest(CASE WHEN speed > 20 THEN (speed - 20) / 20 * 100 ELSE 0 END, 0), 100), 0), 100), 2) AS score FROM m) SELECT entity_id, score, CASE WHEN floor(score) <= 24 THEN 'green' WHEN floor(score) <= 49 THEN 'yellow' WHEN floor(score) <= 74 THEN 'orange' ELSE 'red' END AS level FROM s"


def _threat(spark, d):
    t = model.tracks(spark, d)
    last = t.groupBy("entity_id").agg(F.max(F.struct("ts", "event_id", "lat", "lon", "speed")).alias("l"))
    rows = last.select("entity_id", F.col("l.lat").alias("lat"), F.col("l.lon").alias("lon"), F.col("l.speed").alias("speed"), F.col("l.ts").alias("last_seen"), (F.col("entity_id") % 17 == 0).alias("sanctioned"), (F.col("entity_id") % 101).cast("double").alias("anomaly"), F.lit(20.0).alias("speed_limit"))
    return rules.threat_scores(rows, SITES, F.lit(t.agg(F.max("ts").alias("now")).first()["now"]))


@register("threat_assess", f"SELECT entity_id, score, level FROM ({THREAT})")
def _(spark, d):
    return _threat(spark, d)


@register("threat_summary", f"SELECT level, count(*) AS n FROM ({THREAT}) GROUP BY 1")
def _(spark, d):
    return rules.threat_summary(_threat(spark, d))


LEVEL = "CASE WHEN speed < 10 THEN 'green' WHEN speed < 20 THEN 'yellow' WHEN speed < 30 THEN 'orange' ELSE 'red' END"


@register("threat_level_change", T + f"SELECT event_id, before, level FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY entity_id ORDER BY ts, event_id), 'green') AS before FROM (SELECT *, {LEVEL} AS level FROM t)) WHERE before <> level")
def _(spark, d):
    return rules.level_changes(model.tracks(spark, d).withColumn("level", F.expr(LEVEL)), ["ts", "event_id"]).select("event_id", "before", "level")


NORM = "upper(trim(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')))"


@register("watch_exact", f"SELECT a.entity_id, b.c_custkey AS list_id FROM ({ENT}) a JOIN customer b ON {NORM.format('a.name')} = {NORM.format('replace(b.c_name, chr(35), chr(45))')}")
def _(spark, d):
    listed = model.read(spark, d, "customer").select(F.col("c_custkey").alias("list_id"), F.regexp_replace("c_name", "#", "-").alias("list_name"))
    return rules.exact_screen(ents(spark, d), listed)


@register("watch_fuzzy", f"WITH a AS (SELECT 'supplier-' || s_suppkey AS entity_id, {NORM.format('s_name')} AS n FROM supplier), b AS (SELECT c_custkey AS list_id, {NORM.format('c_name')} AS m FROM customer), ag AS (SELECT entity_id, n, unnest(list_distinct([substr(n, CAST(i AS BIGINT), 3) for i in range(1, length(n) - 1)])) AS t FROM a WHERE length(n) >= 4), q AS (SELECT entity_id, count(*) AS q FROM ag GROUP BY 1), bg AS (SELECT list_id, m, unnest(list_distinct([substr(m, CAST(i AS BIGINT), 3) for i in range(1, length(m) - 1)])) AS t FROM b WHERE length(m) >= 3), h AS (SELECT entity_id, n, list_id, m, count(*) AS c FROM ag JOIN bg USING (t) GROUP BY 1, 2, 3, 4), s AS (SELECT entity_id, list_id, CAST(round((1 - levenshtein(n, m) / CAST(greatest(strlen(n), strlen(m)) AS DOUBLE)) * 100) AS INTEGER) AS score FROM h JOIN q USING (entity_id) WHERE c >= ceil(q * 0.3)) SELECT entity_id, list_id, score, CASE WHEN score = 100 THEN 'confirmed' WHEN score >= 90 THEN 'probable' ELSE 'possible' END AS risk FROM s WHERE score >= 60")
def _(spark, d):
    names = model.entities(spark, d, ("supplier",))
    listed = model.read(spark, d, "customer").select(F.col("c_custkey").alias("list_id"), F.col("c_name").alias("list_name"))
    return rules.fuzzy_screen(names, listed, 60)


@register("resolve_names", "WITH s AS (SELECT s_suppkey AS entity_id, s_nationkey AS block, list_distinct(string_split(lower(s_name), '')) AS x FROM supplier) SELECT a.entity_id AS a, b.entity_id AS b, round(len(list_intersect(a.x, b.x)) / CAST(len(list_distinct(list_concat(a.x, b.x))) AS DOUBLE), 6) AS jaccard FROM s a JOIN s b ON a.block = b.block AND a.entity_id < b.entity_id WHERE round(len(list_intersect(a.x, b.x)) / CAST(len(list_distinct(list_concat(a.x, b.x))) AS DOUBLE), 6) > 0.8")
def _(spark, d):
    s = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("block"), F.col("s_name").alias("name"))
    return rules.match_names(s, s)


@register("federated_merge", "SELECT 'customer-' || c_custkey AS entity_id, CASE WHEN least(0.5e0 + (c_custkey % 50) / 100.0e0 + 0.1e0, 0.9e0) > 0.5e0 + (c_custkey % 50) / 100.0e0 THEN 'remote' ELSE c_name END AS name FROM customer")
def _(spark, d):
    local = model.entities(spark, d, ("customer",)).select("entity_id", "name", "confidence")
    remote = local.select("entity_id", F.lit("remote").alias("name"), (F.col("confidence") + 0.1).alias("confidence"))
    return rules.federated_merge(local, remote).select("entity_id", "name")


AUDIT_RUN = 4096


def _chained(pdf):
    """One run of orders as a hash chain of its own; the place before a run stays free, so its first row has no predecessor."""
    pdf = pdf.sort_values("o_orderkey")
    before, out = "", []
    for place, (key, op) in enumerate(zip(pdf["o_orderkey"], pdf["op"])):
        seq = int(pdf["run"].iloc[0]) * (AUDIT_RUN + 1) + 1 + place
        h = hashlib.sha256(f"{before}|{seq}|{op}".encode()).hexdigest()
        out.append((key, seq, op, before, h))
        before = h
    return pd.DataFrame(out, columns=["o_orderkey", "seq", "op", "previous_hash", "content_hash"])


def _audit_log(spark, d):
    o = model.read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("op"), F.floor(F.col("o_orderkey") / AUDIT_RUN).alias("run"))
    return o.groupBy("run").applyInPandas(_chained, "o_orderkey long, seq long, op string, previous_hash string, content_hash string")


@register("audit_verify", "SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 = 3")
def _(spark, d):
    log = _audit_log(spark, d)
    forged = log.withColumn("op", F.when(F.col("o_orderkey") % 1000 == 3, F.lit("forged")).otherwise(F.col("op")))
    return rules.verify_chain(forged, ["seq", "op"]).join(log.select("seq", "o_orderkey"), "seq").select("o_orderkey")


@register("policy_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2)")
def _(spark, d):
    return rules.allowed(model.read(spark, d, "customer"), [{"effect": "allow", "column": "c_mktsegment", "values": ["BUILDING", "MACHINERY"]}, {"effect": "deny", "column": "c_nationkey", "values": [1, 2]}]).select("c_custkey")


@register("classification_filter", "SELECT c_custkey FROM customer WHERE c_nationkey % 4 <= 2 AND c_mktsegment IN ('BUILDING', 'FURNITURE')")
def _(spark, d):
    return model.read(spark, d, "customer").where(rules.dominates(F.col("c_nationkey") % 4, F.array("c_mktsegment"), 2, ["BUILDING", "FURNITURE"])).select("c_custkey")


@register("anomaly_quantile", T + ", w AS (SELECT *, list(value) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 2048 PRECEDING AND 1 PRECEDING) AS h FROM t), q AS (SELECT entity_id, event_id, value, list_sort(h) AS h, len(h) AS n FROM w WHERE len(h) >= 32), e AS (SELECT *, h[CAST(floor((n - 1) * 0.025e0) AS BIGINT) + 1] AS lo, h[CAST(floor((n - 1) * 0.975e0) AS BIGINT) + 1] AS hi FROM q) SELECT entity_id, event_id, round(least(greatest(lo - value, value - hi, 0) / greatest(hi - lo, 1e-9) * 100, 100), 4) AS score FROM e")
def _(spark, d):
    return rules.quantile_envelope(model.tracks(spark, d), "value", warm_up=32)


@register("ingest_detect_type", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ship' WHEN event_id % 3 = 1 THEN 'sensor' ELSE 'generic' END AS entity_type, CASE WHEN event_id % 3 = 0 THEN 'ship-' || event_id WHEN event_id % 3 = 1 THEN 'sensor-s' || event_id END AS id FROM events")
def _(spark, d):
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"mmsi":"'), F.col("event_id").cast("string"), F.lit('","lat":51.5}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"temperature":3,"id":"s'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(F.col("props"))
    ok, _bad = ingest.ingest(model.read(spark, d, "events").select("event_id", payload.alias("payload")))
    return ok.select("event_id", "entity_type", F.when(F.col("entity_type") != "generic", F.col("entity_id")).alias("id"))


@register("ingest_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    e = model.read(spark, d, "events").select("event_id", F.concat(F.lit('{"a":{"b":'), "props", F.lit('},"c":[1,2]}')).alias("payload"))
    return e.select("event_id", F.element_at(ingest.flatten(F.col("payload")), "a.b.k").cast("long").alias("k"))


@register("source_sbs", "SELECT 'icao:' || printf('%06X', user_id) AS entity_id, event_id, CAST(event_id % 100 AS DOUBLE) AS lat, value FROM events WHERE event_id % 5 IN (2, 3)")
def _(spark, d):
    icao, number = F.lpad(F.hex("user_id"), 6, "0"), F.col("event_id").cast("string")
    line = F.concat_ws(",", F.lit("MSG"), (F.col("event_id") % 5).cast("string"), F.lit("1,1"), icao, F.lit("1,,,,"), number, F.lit("30000"), F.col("value").cast("string"), F.lit("90"), (F.col("event_id") % 100).cast("string"), F.lit("4.5,0,7000,0,0,0,0"))
    rows = feeds.sbs(model.read(spark, d, "events").select(line.alias("value")))
    return rows.select("entity_id", F.element_at("properties", "callsign").cast("long").alias("event_id"), "lat", F.element_at("properties", "speed").cast("double").alias("value"))


@register("source_cef", "SELECT 'cef:ven|dor:prod:' || event_type AS entity_id, CASE WHEN event_id % 12 <= 3 THEN 'Low' WHEN event_id % 12 <= 6 THEN 'Medium' WHEN event_id % 12 <= 8 THEN 'High' WHEN event_id % 12 <= 10 THEN 'Very-High' ELSE 'Unknown' END AS severity, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")
def _(spark, d):
    line = F.concat(F.lit(r"CEF:0|ven\|dor|prod|1|"), "event_type", F.lit("|name|"), (F.col("event_id") % 12).cast("string"), F.lit("|src=10.0.0.1 msg=a b cn1="), F.col("event_id").cast("string"))
    rows = feeds.cef(model.read(spark, d, "events").select(line.alias("value")))
    return rows.groupBy("entity_id", F.element_at("properties", "severity").alias("severity")).agg(F.count("*").alias("n"), F.sum(F.element_at("properties", "ext_cn1").cast("long")).alias("ids"))


@register("source_geojson", "SELECT 'e' || event_id AS entity_id, event_type AS entity_type, CAST(event_id % 90 AS DOUBLE) + 1.0e0 AS lat, CAST(event_id % 180 AS DOUBLE) AS lon FROM events")
def _(spark, d):
    lat, lon = (F.col("event_id") % 90).cast("string"), (F.col("event_id") % 180).cast("string")
    above = (F.col("event_id") % 90 + 2).cast("string")
    text = F.concat(F.lit('{"type":"Feature","id":"e'), F.col("event_id").cast("string"), F.lit('","geometry":{"type":"LineString","coordinates":[['), lon, F.lit(","), lat, F.lit("],["), lon, F.lit(","), above, F.lit(']]},"properties":{"entity_type":"'), "event_type", F.lit('"}}'))
    return feeds.geojson(model.read(spark, d, "events").select(text.alias("value"))).drop("properties")


@register("source_envelope", "SELECT 'u' || user_id AS entity_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def _(spark, d):
    text = F.concat(F.lit('{"device_id":"u'), F.col("user_id").cast("string"), F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    rows = feeds.envelope(model.read(spark, d, "events").select(text.alias("value")), "sensor")
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum(F.element_at("properties", "k").cast("long")).alias("k"))


@register("stream_windows", "SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS window_start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def _(spark, d):
    e = model.read(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows = streams.windowed(e, ["event_type"], "6 hours", [F.count("*").alias("n"), F.max("value").alias("top")])
    return rows.select(F.unix_timestamp("window_start").cast("double").alias("window_start"), "event_type", "n", "top")


@register("stream_sessions", "WITH o AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n_events FROM s GROUP BY 1, 2")
def _(spark, d):
    rows = streams.sessions(model.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), ["user_id"], "12 hours")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("session_start"))
    return rows.select("user_id", turn.cast("long").alias("session"), "n_events")
