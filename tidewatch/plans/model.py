"""Entities, relationships, events and tracks derived from the star-schema tables.

Properties are typed columns, so filters and projections on them reach the Parquet
scan; a filter on the type removes the other tables from the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CORE = ["entity_id", "entity_type", "name", "lat", "lon", "confidence", "is_active"]
TYPES = {
    "customer": ("customer", "c_custkey", "c_name", {"nationkey": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "supplier": ("supplier", "s_suppkey", "s_name", {"nationkey": "s_nationkey", "acctbal": "s_acctbal"}),
    "part": ("part", "p_partkey", "p_name", {"brand": "p_brand", "ptype": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "order": ("orders", "o_orderkey", None, {"status": "o_orderstatus", "totalprice": "o_totalprice", "priority": "o_orderpriority"}),
    "nation": ("nation", "n_nationkey", "n_name", {}),
    "region": ("region", "r_regionkey", "r_name", {}),
}
PROPERTIES = {"nationkey": "int", "acctbal": "double", "mktsegment": "string", "brand": "string", "ptype": "string", "size": "int", "retailprice": "double", "status": "string", "totalprice": "double", "priority": "string"}
RELATIONS = {
    "placed_by": ("orders", "order", "o_orderkey", "customer", "o_custkey"),
    "contains": ("lineitem", "order", "l_orderkey", "part", "l_partkey"),
    "supplied_by": ("lineitem", "order", "l_orderkey", "supplier", "l_suppkey"),
    "customer_nation": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "supplier_nation": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    "in_region": ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(key: Column) -> Column:
    return (key.cast("long") * 7919 % 18000) / F.lit(100.0) - 90.0


def lon_of(key: Column) -> Column:
    return (key.cast("long") * 104729 % 36000) / F.lit(100.0) - 180.0


def entities(spark: SparkSession, sf_dir: str, types=("customer", "supplier", "part")) -> DataFrame:
    parts = []
    for t in types:
        table, key, name, props = TYPES[t]
        k = F.col(key)
        parts.append(read(spark, sf_dir, table).select(F.concat(F.lit(t + "-"), k.cast("string")).alias("entity_id"), F.lit(t).alias("entity_type"), (F.col(name) if name else F.concat(F.lit(t + " "), k.cast("string"))).alias("name"), lat_of(k).alias("lat"), lon_of(k).alias("lon"), (F.lit(0.5) + (k.cast("long") % 50) / F.lit(100.0)).alias("confidence"), (k.cast("long") % 10 != 0).alias("is_active"), *[(F.col(props[p]).cast(kind) if p in props else F.lit(None).cast(kind)).alias(p) for p, kind in PROPERTIES.items()]))
    return reduce(DataFrame.unionByName, parts)


def relationships(spark: SparkSession, sf_dir: str, types=tuple(RELATIONS)) -> DataFrame:
    """(source_id, target_id, rel_type), distinct."""
    parts = []
    for r in types:
        table, st, sk, tt, tk = RELATIONS[r]
        rows = read(spark, sf_dir, table).select(F.concat(F.lit(st + "-"), F.col(sk).cast("string")).alias("source_id"), F.concat(F.lit(tt + "-"), F.col(tk).cast("string")).alias("target_id"), F.lit(r).alias("rel_type"))
        parts.append(rows.distinct() if table == "lineitem" else rows)
    return reduce(DataFrame.unionByName, parts)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per event: an entity drifts around an anchor; speed from the value, course from the payload."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", (lat_of(F.col("user_id")) / 3 + (F.col("event_id") % 100) / F.lit(1000.0)).alias("lat"), (lon_of(F.col("user_id")) / 3 + (F.col("event_id") % 77) / F.lit(1000.0)).alias("lon"), (F.col("value") % 40.0).alias("speed"), (k * 37 % 360).cast("double").alias("course"), F.col("value").alias("value"))


_NUM = {"int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def entity_sql(types=("customer", "supplier", "part")) -> str:
    out = []
    for t in types:
        table, key, name, props = TYPES[t]
        cols = ", ".join(f"CAST({props.get(p, 'NULL')} AS {_NUM[kind]}) AS {p}" for p, kind in PROPERTIES.items())
        out.append(f"SELECT '{t}-' || {key} AS entity_id, '{t}' AS entity_type, {name or repr(t + ' ') + ' || ' + key} AS name, (CAST({key} AS BIGINT) * 7919 % 18000) / 100.0e0 - 90.0e0 AS lat, (CAST({key} AS BIGINT) * 104729 % 36000) / 100.0e0 - 180.0e0 AS lon, 0.5e0 + ({key} % 50) / 100.0e0 AS confidence, {key} % 10 <> 0 AS is_active, {cols} FROM {table}")
    return " UNION ALL ".join(out)


def relation_sql(types=tuple(RELATIONS)) -> str:
    return " UNION ALL ".join(f"(SELECT DISTINCT '{RELATIONS[r][1]}-' || {RELATIONS[r][2]} AS source_id, '{RELATIONS[r][3]}-' || {RELATIONS[r][4]} AS target_id, '{r}' AS rel_type FROM {RELATIONS[r][0]})" for r in types)


TRACK_SQL = "SELECT event_id, user_id AS entity_id, ts, event_type, ((user_id * 7919 % 18000) / 100.0e0 - 90.0e0) / 3 + (event_id % 100) / 1000.0e0 AS lat, ((user_id * 104729 % 36000) / 100.0e0 - 180.0e0) / 3 + (event_id % 77) / 1000.0e0 AS lon, value % 40.0e0 AS speed, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 37 % 360 AS DOUBLE) AS course, value FROM events"
