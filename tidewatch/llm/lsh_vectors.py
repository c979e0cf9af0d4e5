"""Near-duplicate embeddings by Euclidean p-stable hashing (op3).

Vectors are normalised, so cosine >= 0.98 is a distance of at most 0.2.  Each of
TABLES tables quantises PROJECTIONS Gaussian projections into cells of WIDTH; a
bucket is (label, table, quantised projections).  A pair at distance 0.2 shares one
table with probability 0.24, so it misses all 50 with 1e-6.

Equal vectors of a label collapse to one class with a count, named by a 128-bit digest and
numbered; buckets hold classes, however many copies one has.  All members of a bucket
are compared by sketches of SKETCH sign bits, in cells of bounded size: a pair at the
limit differs in 16 bits on average and in more than SKETCH_BITS of them with 1e-9.  A cell
returns a spanning forest of its pairs within SKETCH_BITS, so every pair of a shared
bucket that could link is joined whatever else the bucket holds.  The forests join
classes into families, which are cut into bounded cells where every pair meets exactly
once and the cosine in double precision decides.  A cell returns, for each of its
vectors, the number of links found there and a spanning forest: rows grow with the
vectors, not with the pairs.

Tiny and huge vectors are first brought to ordinary size by a power of two, so they
have a direction too.

Defined cases: a null label, a null or zero vector, or one with null or non-finite
components links with nothing (n_links 0, its own component, kept).  Vectors of
different lengths never link.  Null vec_id: not linked, component_id null, kept.
Repeated rows count as other vectors of the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .common import byte_bound, drop_staged, staged
from .graph import cells, components, join_classes
from .minhash import by_cell

COSINE, TABLES, PROJECTIONS, WIDTH = 0.98, 50, 10, 1.2
SKETCH, SKETCH_BITS, SKETCH_BLOCK, FAMILY_BLOCK = 256, 46, 1024, 256


def _planes(dim: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    if dim not in cache:
        rng = np.random.default_rng([20240602, dim])
        cache[dim] = rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    return cache[dim]


def _signs(dim: int, cache: dict = {}) -> np.ndarray:
    if dim not in cache:
        cache[dim] = np.random.default_rng([20240603, dim]).standard_normal((dim, SKETCH))
    return cache[dim]


def _finite(v: list | None) -> np.ndarray | None:
    if v is None or any(x is None for x in v):
        return None
    x = np.asarray(v, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    top = np.abs(x).max()
    # by a power of two, which is exact, and only where squares could leave the range of doubles
    return x if 1e-100 < top < 1e100 else np.ldexp(x, -int(np.frexp(top)[1]))


def _buckets(x: np.ndarray, label: int) -> np.ndarray:
    planes, shift = _planes(len(x))
    q = np.floor((x @ planes + shift) / WIDTH).astype(np.int64).reshape(TABLES, PROJECTIONS).astype(np.uint64)
    seed = np.array([len(x), label & 0xFFFFFFFFFFFFFFFF], np.uint64)
    acc = tc.mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tc.mix(seed)[0] + tc.mix(tc.mix(seed) + np.uint64(9))[1])
    for j in range(PROJECTIONS):
        acc = tc.mix(acc + q[:, j])
    return acc.view(np.int64)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("label").to_pylist()
        keys, vectors = [], []
        for label, v in zip(labels, batch.column("embedding").to_pylist()):
            x = None if label is None else _finite(v)
            if x is None:
                keys.append(None)
                vectors.append(None)
                continue
            raw = (x + 0.0).tobytes()
            words = np.concatenate([np.frombuffer(raw, np.uint64), np.array([label & 0xFFFFFFFFFFFFFFFF, len(x)], np.uint64)])
            places = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            digest = [tc.mix(tc.mix(words + places * np.uint64(k)).sum(dtype=np.uint64, keepdims=True)) for k in (1, 3)]
            keys.append(np.concatenate(digest).tobytes())
            vectors.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()), batch.column("label")], ["vec_id", "key", "vector", "label"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and sketch of every class."""
    for batch in batches:
        buckets, sketches = [], []
        for label, raw in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
            x = np.frombuffer(raw)
            x = x / np.linalg.norm(x)
            buckets.append(_buckets(x, label))
            sketches.append(np.packbits(x @ _signs(len(x)) >= 0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["node", "buckets", "sketch"])


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of neighbours."""
    seen = np.zeros(len(near), bool)
    for i in np.flatnonzero(near.any(1)):
        if not seen[i]:
            seen[i] = True
            todo = [i]
            while todo:
                x = todo.pop()
                new = np.flatnonzero(near[x] & ~seen)
                seen[new] = True
                todo.extend(new.tolist())
                for y in new:
                    yield x, y


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for a spanning forest of each cell's pairs of near sketches; a partition is sorted by cell."""
    for cuts, part in by_cell(batches, ("bucket", "cell_i", "cell_j")):
        node, own = part.column("node").to_numpy(), part.column("own").to_numpy()
        bits = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH // 8)
        cross = part.column("cell_i").to_numpy() != part.column("cell_j").to_numpy()
        starts, sizes = cuts[:-1], np.diff(cuts)
        p = starts[sizes == 2]
        hit = p[(np.bitwise_count(bits[p] ^ bits[p + 1]).sum(1) <= SKETCH_BITS) & (~cross[p] | (own[p] != own[p + 1]))]
        out_a, out_b = node[hit].tolist(), node[hit + 1].tolist()
        for s, e in zip(starts[sizes > 2], (starts + sizes)[sizes > 2]):
            # the product of signs is SKETCH less twice the bits that differ
            signs = np.unpackbits(bits[s:e], axis=1).astype(np.float32) * 2 - 1
            near = signs @ signs.T >= SKETCH - 2 * SKETCH_BITS
            np.fill_diagonal(near, False)
            if cross[s]:
                near &= own[s:e, None] != own[None, s:e]
            for x, y in _forest(near):
                out_a.append(int(node[s + x]))
                out_b.append(int(node[s + y]))
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per cell: rows (a = node, b = null, links) with the links found here, and (a, b, null) for a spanning forest."""
    key, own, copies = pdf["node"].to_numpy(), pdf["own"].to_numpy(), pdf["copies"].to_numpy()
    cross = bool((pdf["cell_i"] != pdf["cell_j"]).iloc[0])
    v = [np.frombuffer(x) for x in pdf["vector"]]
    out_a, out_b, out_n = [], [], []
    if len(v) > 1 and len({len(x) for x in v}) == 1:
        m = np.stack(v)
        norm = np.sqrt((m * m).sum(1))
        near = (m @ m.T) / np.outer(norm, norm) >= COSINE
        np.fill_diagonal(near, False)
        if cross:
            near &= own[:, None] != own[None, :]
        links = near @ copies
        for i in np.flatnonzero(links):
            out_a.append(int(key[i]))
            out_b.append(None)
            out_n.append(int(links[i]))
        for x, y in _forest(near):
            out_a.append(int(key[x]))
            out_b.append(int(key[y]))
            out_n.append(None)
    return pd.DataFrame({"a": pd.array(out_a, "Int64"), "b": pd.array(out_b, "Int64"), "links": pd.array(out_n, "Int64")})


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    byte_bound(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    hashed = staged(rows.mapInArrow(_hash, "vec_id long, key binary, vector binary, label long"), "hashed")
    named = hashed.where("key is not null and vec_id is not null")
    classes = named.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    dealt = staged(classes.select("node", "vector", "label").mapInArrow(_deal, "node long, buckets array<long>, sketch binary"), "dealt")
    placed = cells(dealt.select("node", F.explode("buckets").alias("bucket")), "bucket", "node", SKETCH_BLOCK, 2, dealt.select("node", "sketch"))
    near = placed.sortWithinPartitions("bucket", "cell_i", "cell_j").select("node", "bucket", "cell_i", "cell_j", "own", "sketch")
    families = components(near.mapInArrow(_sketch_links, "a long, b long"))

    members = families.toDF("node", "family").join(classes.select("node", "copies", "vector"), "node")
    found = staged(cells(members, "family", "node", FAMILY_BLOCK).groupBy("family", "cell_i", "cell_j").applyInPandas(_compare, "a long, b long, links long"), "found")
    labels = components(found.where("b is not null").select("a", "b"))
    n_links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n"))

    grouped = labels.join(classes.select("node", "rep"), "node")
    lowest = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = grouped.join(lowest, "label").select("node", "component_id").join(n_links, "node", "left")
    final = staged(classes.select("node", "key", "rep", "copies").join(linked, "node", "left").select("key", "copies", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "final")
    drop_staged(classes, dealt, found)
    done = join_classes(named.select("vec_id", "key"), final).select("vec_id", "n_links", "component_id")
    alone = hashed.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
