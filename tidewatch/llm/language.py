"""Language identification (op10): nearest centroid over TF-IDF character n-grams.

A text becomes counts of hashed byte bigrams and trigrams over its folded letters
(anything ASCII that is not a letter is a space), weighted sub-linearly and by the
inverse document frequency of the fitting sample, and normalised.  Each language has
several centroids from a spherical k-means, and the nearest one by cosine decides.
Distance rejects: a text whose best cosine lies below its language's limit is marked
`rejected`.  The limit is half of the lowest cosine any allowed labelled text of that
language has to its own language, so ordinary texts stay; a fitting text counts with the
centroids it would leave without it.  A language with one text in all has no limit.

The centroids are fitted on at most FIT_ROWS rows, dealt to the languages in turn by a
hash of the id, at most LANG_ROWS of each: a rare language gives all it has before a
common one gives more.  Everything else, the limits too, reads all rows and whole texts.
Centroids are at most FIT_ROWS * DIM floats and are broadcast behind that bound; labels
beyond FIT_ROWS different ones are not learned.

Defined cases: null text, or text without a letter (Unicode category L) -> `und`, score 0, rejected.
Without any usable label every text is `und`.  Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from . import textcore as tc
from .common import byte_bound, crc_mod

DIM_BITS, FIT_ROWS, CENTROIDS, LANG_ROWS, PARTS = 12, 4000, 4, 1000, 64


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint64)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def counts(arr) -> Iterator[np.ndarray]:
    """Hashed n-gram counts of each row; None for a row without a letter."""
    dim, shift = 1 << DIM_BITS, np.uint64(64 - DIM_BITS)
    table = _letters()
    buf, offs = tc.text_bytes(arr)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    for i in range(len(offs) - 1):
        raw = buf[offs[i] : offs[i + 1]]
        if not ascii_letter[raw].any() and not any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace"))):
            yield None
            continue
        total = np.zeros(dim)
        at = 0
        while True:  # a segment overlaps the one before by two bytes, so no n-gram is lost or counted twice
            seg = np.concatenate([[np.uint64(32)] if at == 0 else table[raw[at - 2 : at]], table[raw[at : at + tc.SEGMENT]]]).astype(np.uint64)
            two = seg[:-1] * np.uint64(256) + seg[1:]
            three = two[:-1] * np.uint64(256) + seg[2:]
            if at:
                two = two[1:]
            code = np.concatenate([(two + np.uint64(1 << 30)) * np.uint64(0x9E3779B97F4A7C15), three * np.uint64(0xC2B2AE3D27D4EB4F)]) >> shift
            total += np.bincount(code.astype(np.int64), minlength=dim)
            at += tc.SEGMENT
            if at >= len(raw):
                break
        yield total


def _packed(c: np.ndarray) -> bytes:
    """The non-zero counts only: their places, then their values."""
    at = np.flatnonzero(c)
    return at.astype(np.uint16).tobytes() + c[at].astype(np.float32).tobytes()


def _unpack(x: bytes, out: np.ndarray) -> None:
    n = len(x) // 6
    out[np.frombuffer(x, np.uint16, n)] = np.frombuffer(x, np.float32, n, 2 * n)


def _collect_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([None if c is None else _packed(c) for c in counts(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), x], ["doc_id", "lang", "x"])


def unit(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _cluster(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, float]:
    """Spherical k-means, k lowered to the number of rows, and the lowest cosine of a row to the centroids left without it."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        total = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    cos = x @ c.T
    for j in range(k):
        at = np.flatnonzero(own == j)
        if len(at) > 1:
            dot = x[at] @ total[j]
            left = np.sqrt(np.maximum(total[j] @ total[j] - 2 * dot + 1, 1e-12))
            cos[at, j] = (dot - 1) / left
        else:
            cos[at, j] = -1.0  # its own centroid, no evidence
    return c, float(cos.max(1).min()) if len(x) > 1 else np.inf


def _lowest(sent):
    """(lang, low): the lowest cosine of a batch's rows to their own language, rows of the fit left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = {name: np.flatnonzero(m["owner"] == i) for i, name in enumerate(m["langs"])}
        for batch in batches:
            low: dict[str, float] = {}
            for key, name, c in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), counts(batch.column("text"))):
                if c is None or name not in place or (key, name) in m["fitted"]:
                    continue
                cos = float((m["centroids"][place[name]] @ unit(c.astype(np.float32), m["idf"])).max())
                low[name] = min(cos, low.get(name, np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.string()), pa.array(list(low.values()), pa.float64())], ["lang", "low"])

    return run


def fit(docs: DataFrame, allowed, fit_rows: int = FIT_ROWS) -> dict:
    """Model from text and non-null lang of the rows for which the column `allowed` holds."""
    byte_bound(docs.sparkSession)
    usable = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    texts = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    turn = F.xxhash64("doc_id")
    named = texts.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").distinct().withColumn("part", F.pmod(turn, F.lit(PARTS)))
    # first within PARTS parts of a language, so that no task sorts a whole common one, twice its share of each
    some = named.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy(turn, "doc_id"))).where(F.col("n") <= 2 * LANG_ROWS // PARTS + 1)
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(turn, "doc_id"))).where(F.col("n") <= LANG_ROWS)
    ids = some.orderBy("n", turn, "doc_id", "lang").select("doc_id", "lang").limit(fit_rows)
    # at most fit_rows rows of 8 bytes and a label
    rows = texts.join(F.broadcast(ids), ["doc_id", "lang"]).mapInArrow(_collect_counts, "doc_id long, lang string, x binary").where("x is not null")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id", "lang"])
    dim = 1 << DIM_BITS
    if not len(rows):
        return {"langs": [], "idf": np.ones(dim), "centroids": np.zeros((0, dim)), "owner": np.zeros(0, int), "limit": np.zeros(0)}
    # one dense matrix of at most fit_rows rows, changed in place, so the driver holds little else
    x = np.zeros((len(rows), dim), np.float32)
    for i, packed in enumerate(rows["x"]):
        _unpack(packed, x[i])
    lang = rows["lang"].to_numpy()
    fitted = set(zip(rows["doc_id"].tolist(), lang))
    del rows
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    langs = sorted(set(lang))
    rng = np.random.default_rng(11)
    parts, lows = zip(*[_cluster(x[lang == name], CENTROIDS, rng) for name in langs])
    del x
    model = {"langs": langs, "idf": idf, "centroids": np.concatenate(parts).astype(np.float32), "owner": np.repeat(np.arange(len(parts)), [len(p) for p in parts])}
    sent = docs.sparkSession.sparkContext.broadcast(model | {"fitted": fitted})
    others = {r["lang"]: r["low"] for r in texts.select("doc_id", "lang", "text").mapInArrow(_lowest(sent), "lang string, low double").groupBy("lang").agg(F.min("low").alias("low")).collect()}
    lows = [min(low, others.get(name, np.inf)) for name, low in zip(langs, lows)]
    return model | {"limit": np.array([0.5 * low if np.isfinite(low) else 0.0 for low in lows])}


def _assign(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            names, scores, out = [], [], []
            for c in counts(batch.column("text")):
                if c is None or not m["langs"]:
                    names.append("und")
                    scores.append(0.0)
                    out.append(True)
                    continue
                cos = m["centroids"] @ unit(c.astype(np.float32), m["idf"])
                best = int(cos.argmax())
                own = int(m["owner"][best])
                names.append(m["langs"][own])
                scores.append(float(min(1.0, max(0.0, cos[best]))))
                out.append(bool(cos[best] < m["limit"][own]))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """key column, lang_pred, score, rejected for every row of docs(key, text)."""
    byte_bound(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_assign(sent), f"`{key}` {kind}, lang_pred string, score double, rejected boolean")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned only where crc32(doc_id) mod 4 is not 2."""
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return predict(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected; columns unchanged."""
    model = fit(docs, crc_mod("doc_id", 4) != 2)
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    return predict(boxed, model, "_doc").where(~F.col("rejected")).select("_doc.*")
