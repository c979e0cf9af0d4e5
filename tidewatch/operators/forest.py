"""Isolation forest: fitted on a bounded sample, broadcast, and applied to all rows in Arrow batches.

The sample is the `sample` rows with the least hash of their key: the same for any
partitioning, and a documented bound whatever the size of the table.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

VERSION = 1


def usual_depth(n: float) -> float:
    """Mean depth of a search that fails in a tree of n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as flat arrays: a split names its column, threshold and left child (the right one follows it), a leaf its depth."""

    columns: int
    rows: int
    trees: list[dict]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 100 for each row; the sooner a row stands alone, the higher."""
        if not self.trees or x.shape[1] != self.columns:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for t in self.trees:
            column, threshold, left, depth = (np.asarray(t[k]) for k in ("column", "threshold", "left", "depth"))
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                going = np.flatnonzero(column[at] >= 0)
                if not len(going):
                    break
                node = at[going]
                at[going] = left[node] + (x[going, column[node]] >= threshold[node])
            total += depth[at]
        norm = usual_depth(self.rows) or 1.0
        return np.clip(100 * np.exp2(-total / len(self.trees) / norm), 0, 100)

    def dumps(self) -> str:
        return json.dumps({"version": VERSION, "columns": self.columns, "rows": self.rows, "trees": self.trees})

    @staticmethod
    def loads(text: str, columns: int) -> Forest:
        d = json.loads(text)
        if d.get("version") != VERSION:
            raise ValueError(f"forest of version {d.get('version')}, not {VERSION}")
        if d["columns"] != columns:
            raise ValueError(f"forest of {d['columns']} features, not {columns}")
        return Forest(d["columns"], d["rows"], d["trees"])


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> dict:
    tree: dict = {"column": [-1], "threshold": [0.0], "left": [0], "depth": [0.0]}
    todo = [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        wide = np.flatnonzero(np.ptp(rows, axis=0) > 1e-7) if len(rows) > 1 and depth < limit else []
        if not len(wide):
            tree["depth"][node] = depth + usual_depth(len(rows))
            continue
        c = int(rng.choice(wide))
        low, high = float(rows[:, c].min()), float(rows[:, c].max())
        at = float(np.nextafter(low, high)) if (u := low + rng.random() * (high - low)) <= low else u
        child = len(tree["column"])
        tree["column"][node], tree["threshold"][node], tree["left"][node] = c, at, child
        for k, blank in (("column", -1), ("threshold", 0.0), ("left", 0), ("depth", 0.0)):
            tree[k] += [blank, blank]
        right = rows[:, c] >= at
        todo += [(child, rows[~right], depth + 1), (child + 1, rows[right], depth + 1)]
    return tree


def fit(x: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 42) -> Forest:
    if x.ndim != 2 or not x.size:
        raise ValueError("a forest needs rows with features")
    rows = max(1, min(rows, len(x)))
    limit = max(1, math.ceil(math.log2(rows)))
    rng = np.random.default_rng(seed)
    return Forest(x.shape[1], rows, [_grow(x[rng.integers(0, len(x), rows)], limit, rng) for _ in range(trees)])


def fit_sample(df: DataFrame, features: list[str], key: str, sample: int = 4096, **named) -> Forest:
    """A forest of a bounded sample: the rows without null features that have the least hash of their key."""
    whole = df.where(F.expr(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in features)))
    picked = whole.select(F.xxhash64(key).alias("_h"), F.col(key).alias("_k"), *features).orderBy("_h", "_k", *features).limit(sample).toPandas()
    return fit(picked[features].to_numpy(dtype=np.float64), **named)


def score(df: DataFrame, features: list[str], forest: Forest) -> DataFrame:
    """df with `score` from 0 to 100; rows with a null feature have 0."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        values = x.to_numpy(dtype=np.float64)
        whole = np.isfinite(values).all(axis=1)
        out = np.zeros(len(values))
        out[whole] = held.value.scores(values[whole])
        return pd.Series(out)

    return df.withColumn("score", run(F.struct(*[F.col(c).cast("double") for c in features])))
