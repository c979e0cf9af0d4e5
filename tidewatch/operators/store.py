"""Entity store and event log: access paths, latest-state merges, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions import geo


def get_entity(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.where(F.col("entity_id") == entity_id)


def by_type(entities: DataFrame, entity_type: str, limit: int, offset: int = 0, order: str = "name") -> DataFrame:
    """Active entities of a type (any letter case), by `order` descending and then id."""
    rows = entities.where((F.lower("entity_type") == entity_type.lower()) & F.col("is_active"))
    return rows.orderBy(F.col(order).desc(), "entity_id").offset(offset).limit(limit)


def search(entities: DataFrame, text: str, entity_type: str | None = None) -> DataFrame:
    rows = entities.where(F.lower("entity_type") == entity_type.lower()) if entity_type else entities
    low = text.lower()
    return rows.where(F.lower("name").contains(low) | F.lower("entity_id").contains(low)) if text else rows


def in_radius(entities: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    return entities.where(geo.point_in_radius(F.col("lat"), F.col("lon"), lat, lon, radius_km))


def in_polygon(entities: DataFrame, wkt: str) -> DataFrame:
    return entities.where(geo.point_in_polygon(F.col("lat"), F.col("lon"), geo.parse_wkt_polygon(wkt)))


def stats(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def events_in(events: DataFrame, start=None, end=None, event_type=None, entity_ids: DataFrame | None = None) -> DataFrame:
    """Inclusive time range, optional type, optional semi-join on (entity_id)."""
    rows = events
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if event_type is not None:
        rows = rows.where(F.col("event_type") == event_type)
    return rows.join(entity_ids, "entity_id", "left_semi") if entity_ids is not None else rows


def edges_of(relationships: DataFrame, entity_id: str, direction: str = "both", rel_type: str | None = None) -> DataFrame:
    out, into = F.col("source_id") == entity_id, F.col("target_id") == entity_id
    rows = relationships.where({"out": out, "in": into, "both": out | into}[direction])
    return rows.where(F.col("rel_type") == rel_type) if rel_type else rows


def upsert(current: DataFrame, changes: DataFrame, key: str = "entity_id", ts: str = "last_updated") -> DataFrame:
    """Latest state: per key the row with the greatest time wins; a partial maximum, so hot keys combine map-side."""
    columns = current.columns
    both = current.unionByName(changes.select(columns))
    rest = [c for c in columns if c not in (key, ts)]
    return both.groupBy(key).agg(F.max_by(F.struct(ts, *rest), F.struct(ts, *rest)).alias("s")).select(*[F.col(key) if c == key else F.col(f"s.{c}") for c in columns])


def insert_events(log: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """Append only events whose id the log does not hold."""
    return log.unionByName(new.dropDuplicates([key]).join(log.select(key), key, "left_anti").select(log.columns))


def latest_properties(history: DataFrame, keys=("entity_id", "key"), ts: str = "ts") -> DataFrame:
    return history.groupBy(*keys).agg(F.max_by("value", ts).alias("value"), F.max(ts).alias(ts))


def as_of(history: DataFrame, when, key: str = "entity_id", ts: str = "ts") -> DataFrame:
    """State at a time: per key the last row not after it."""
    rows = history.where(F.col(ts) <= F.lit(when).cast("timestamp"))
    rest = [c for c in history.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(ts, *[c for c in rest if c != ts])).alias("s")).select(key, *[F.col(f"s.{c}") for c in rest])


def soft_delete(entities: DataFrame, gone: DataFrame) -> DataFrame:
    marked = entities.join(gone.select("entity_id").distinct().withColumn("_gone", F.lit(True)), "entity_id", "left")
    return marked.withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def geojson(entities: DataFrame) -> DataFrame:
    """One GeoJSON feature per entity as text."""
    props = [c for c in entities.columns if c not in ("lat", "lon")]
    shape = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    return entities.select("entity_id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


def top_per(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def events_of(events: DataFrame, entity_id, limit: int) -> DataFrame:
    """Events of one entity, newest first; ties by id."""
    return events.where(F.col("entity_id") == entity_id).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)


def count_entities(entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    """(n): active entities, of a type (any letter case) or of all."""
    rows = entities.where("is_active")
    return (rows.where(F.lower("entity_type") == entity_type.lower()) if entity_type else rows).agg(F.count("*").alias("n"))


def page(entities: DataFrame, entity_type: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of `by_type` with the count of all its pages' rows on each row."""
    return by_type(entities, entity_type, limit, offset).crossJoin(F.broadcast(count_entities(entities, entity_type).withColumnRenamed("n", "total")))


def find(entities: DataFrame, near: tuple[float, float, float] | None = None, text: str = "", entity_type: str | None = None) -> DataFrame:
    """Search by place (lat, lon, radius in km) or else by text."""
    if near is None:
        return search(entities, text, entity_type)
    lat, lon, radius = near
    if not (-90 <= lat <= 90 and -180 <= lon <= 180 and radius > 0):
        raise ValueError(f"not a place and radius: {near}")
    rows = in_radius(entities, lat, lon, radius)
    return rows.where(F.lower("entity_type") == entity_type.lower()) if entity_type else rows


def as_json(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, value): each row as a JSON object, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("value"))


def as_csv(rows: DataFrame) -> DataFrame:
    """(value): each row as a CSV line; cells with commas, quotes or line ends are quoted, nulls empty."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return rows.select(F.concat_ws(",", *[cell(c) for c in rows.columns]).alias("value"))


def expire(rows: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows that the time to live still keeps."""
    return rows.where(F.col(ts) >= as_of.cast("timestamp") - F.make_dt_interval(F.lit(days)))


def source_status(sources: DataFrame, beats: DataFrame, as_of: Column, silent_s: int = 300) -> DataFrame:
    """Data sources (source_id, enabled) with their heartbeats (source_id, ts, events, errors): totals and a status.

    disabled, unknown (no heartbeat), error (more errors than events), stale (silent too long), or healthy.
    """
    seen = beats.groupBy("source_id").agg(F.max("ts").alias("last_seen"), F.sum("events").alias("events"), F.sum("errors").alias("errors"))
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("last_seen")
    status = F.when(~F.col("enabled"), "disabled").when(F.col("last_seen").isNull(), "unknown").when(F.col("errors") > F.col("events"), "error").when(age > silent_s, "stale").otherwise("healthy")
    return sources.join(seen, "source_id", "left").select("source_id", "last_seen", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("errors", F.lit(0)).alias("errors"), status.alias("status"))
