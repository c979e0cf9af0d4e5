"""Structured Streaming forms of ingest: suppression of repeats, windows, change log, dead letters.

Every operator that keeps state bounds it by a watermark.  Sinks write a folder per batch
number and replace it when a batch is repeated, so a restart leaves no row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def suppress_repeats(events: DataFrame, ts: str = "ts", window: str = "1 hour", payload=("event_type", "source_id", "data")) -> DataFrame:
    """First event of each entity and content within the window, by event time (the time itself is not part of the content)."""
    content = F.xxhash64(*[F.col(c) for c in payload if c in events.columns])
    if not events.isStreaming:
        raise ValueError("a batch is served by operators.rules.anchored_dedup")
    return events.withColumn("_content", content).withWatermark(ts, window).dropDuplicatesWithinWatermark(["entity_id", "_content"]).drop("_content")


def windowed(events: DataFrame, keys: list[str], size: str, aggregates: list[Column], ts: str = "ts", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates over tumbling or sliding windows; rows later than `late` are dropped on a stream alone."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed.groupBy(span.alias("w"), *keys).agg(*aggregates).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sessions(events: DataFrame, keys: list[str], gap: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One row per key and stretch of events less than `gap` apart."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def change_log(stream: DataFrame, path: str, checkpoint: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, every: str | None = None):
    """Start a query that appends to path/changes and, with `parse`, failed rows to path/dead.

    parse(rows) gives (good rows, dead letters).  Without `every` the query takes what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, dead = parse(batch) if parse else (batch, None)
        good.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if dead is not None:
            dead.withColumn("retry_count", F.lit(0)).write.mode("overwrite").parquet(f"{path}/dead/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, path: str, ts: str = "ts", key: str = "entity_id") -> DataFrame:
    """Latest state per entity of a change log: the last row by event time, then by batch."""
    log = spark.read.parquet(f"{path}/changes")
    rest = [c for c in log.columns if c not in (key, ts, "batch")]
    last = log.groupBy(key).agg(F.max_by(F.struct(ts, *rest), F.struct(ts, "batch")).alias("x"))
    return last.select(key, "x.*")


def retry(dead: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows that now parse, dead letters with one more attempt counted); at the limit letters are kept but not tried."""
    rows = dead.drop("error")
    good, bad = parse(rows.where(F.col("retry_count") < limit))
    spent = dead.where(F.col("retry_count") >= limit)
    return good, bad.withColumn("retry_count", F.col("retry_count") + 1).unionByName(spent, allowMissingColumns=True)


def merged(log: DataFrame, key: str = "entity_id", ts: str = "ts") -> DataFrame:
    """(key, ts, properties): the latest value of each single property of a change log, so a partial message keeps the rest."""
    each = log.select(key, ts, F.explode("properties").alias("k", "v"))
    last = each.groupBy(key, "k").agg(F.max_by("v", F.struct(ts, "v")).alias("v"))
    props = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return log.groupBy(key).agg(F.max(ts).alias(ts)).join(props, key, "left")


def outbox(changes: DataFrame, acks: DataFrame, peers: list[str]) -> DataFrame:
    """(peer, seq, ...): changes that a peer has not yet acknowledged, after the greatest seq of its acks (peer, seq)."""
    done = acks.groupBy("peer").agg(F.max("seq").alias("_done"))
    wanted = changes.withColumn("peer", F.explode(F.array(*[F.lit(p) for p in peers])))
    return wanted.join(F.broadcast(done.where(F.col("peer").isin(peers))), "peer", "left").where("_done is null or seq > _done").drop("_done")
