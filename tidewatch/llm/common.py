"""Shared plumbing: table access, staged tables on the shared folder, bounds on Arrow batches, worker-side caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def staged(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The written table survives lost executors, is computed once however often it
    is used, and gives the planner real sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def drop_staged(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def byte_bound(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that a batch of long texts stays small in a Python worker.

    Only the size of batches changes, never a result, and only where the session allows more.  The
    setting is read when a job runs, after the operator has returned, so it stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < bytes_now <= most:
        spark.conf.set(key, str(most))


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    module = sys.modules.setdefault("_tidewatch_worker_cache", types.ModuleType("_tidewatch_worker_cache"))
    return module.__dict__.setdefault("cache", {})


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed, in which the first bits of every hash(long) in the column `hash` are set; built on the executors."""
    chunk = min(bits, 19)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << chunk, bool)
        own[pdf["bit"].to_numpy() & ((1 << chunk) - 1)] = True
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [np.packbits(own).tobytes()]})

    placed = hashes.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit")).distinct().withColumn("part", F.shiftright("bit", chunk))
    whole, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (chunk - 3)
    for r in placed.groupBy("part").applyInPandas(pack, "part long, bits binary").toLocalIterator():  # as many bytes in all as the bitmap has
        whole[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return whole


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.uint64) >> np.uint64(61 - (len(bitmap).bit_length() - 1))
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def sieve(keys: DataFrame, key: str, most_bytes: int = 16 << 20):
    """A function of a key column that is false only for keys that `keys`, a staged table, does not hold.

    It rests on a bitmap of 32 bits a key, most_bytes at most, which the plan holds as the value of a
    scalar subquery, so rows it turns away need no join
    and no shuffle.  Beyond that size it lets more rows through; a join behind it decides.
    """
    n = keys.count()
    bits = min(max(16, (32 * n).bit_length()), (most_bytes * 8).bit_length() - 1)
    spark = keys.sparkSession
    whole = spark.createDataFrame([(bitmap_of(keys.select(F.xxhash64(key).alias("hash")), bits).tobytes(),)], "bits binary")

    def of(column: Column) -> Column:
        bit = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
        byte = whole.scalar().substr((F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.when((bit % 8) == 7, value % 2 == 1).otherwise(F.floor(value / F.pow(F.lit(2), 7 - bit % 8)) % 2 == 1)

    return of
