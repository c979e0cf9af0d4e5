"""Benchmark decontamination (op6): a broadcast hash set of normalised test windows, scanned over whole texts.

A window is WINDOW consecutive item words (an item of fewer, but not none, is one
window).  Windows are cut and hashed on the executors and staged once with their words.
Their hashes alone are broadcast, as one sorted array per length: 8 bytes a window and HASH_BYTES at
most.  Of a larger set, a bitmap of its hashes of that size goes out instead.  What hits
in a text is verified by a join with the staged windows on length, hash and words, so neither a
collision nor a bit that other windows share can count.

Hits are held by text (a 128-bit digest), not by row, so copies are verified once.  Windows that
occur in very many texts, and texts with very many copies, are broadcast in the joins, so
neither is in one task.

Defined cases: null or empty text has no words (n_words 0, not contaminated); null,
empty or word-less items have no window; repeated items with one id count once;
null item_id is left out of the list of items but its windows still hit; repeated rows
are reported each; columns of docs may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .common import bitmap_of, byte_bound, in_bitmap, sieve, staged
from .graph import join_classes

WINDOW, HASH_BYTES, BITS = 10, 32 << 20, 20
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = pa.list_(pa.struct([("k", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("words", pa.string())]))


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word, fold = tc.class_table(tc.ALNUM), tc.fold_table()
    for batch in batches:
        items = batch.column("item_id").to_pylist()
        buf, offs = tc.text_bytes(batch.column("text"))
        for i, item in enumerate(items):
            part = buf[offs[i] : offs[i + 1]]
            h, s, e, _ = tc.words(part, np.array([0, len(part)]), word, fold)
            if not len(h):
                continue
            k = min(WINDOW, len(h))
            low, grams = fold[part].tobytes(), tc.ngrams(h, k).view(np.int64)
            for a in range(0, len(grams), 10_000):
                own = [b" ".join(low[s[j] : e[j]] for j in range(p, p + k)).decode() for p in range(a, min(len(grams), a + 10_000))]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(grams[a : a + 10_000]), pa.array(own, pa.string()), pa.array([item] * len(own), pa.int64())], ["k", "hash", "words", "item_id"])


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(k, hash, words, item_id) of the distinct windows of every item, staged."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return staged(items.mapInArrow(_cut_windows, "k int, hash long, words string, item_id long").distinct(), "windows")


def hash_sets(windows: DataFrame, hash_bytes: int = HASH_BYTES) -> dict:
    """k -> sorted hashes, where 8 bytes a window stay within hash_bytes; beyond, 0 -> a bitmap of that size over all lengths."""
    distinct = windows.select("k", "hash").distinct()
    if distinct.count() * 8 <= hash_bytes:
        rows = distinct.toPandas()  # at most hash_bytes of hashes
        return {int(k): np.sort(part["hash"].to_numpy().view(np.uint64)) for k, part in rows.groupby("k")}
    return {0: bitmap_of(distinct.select("hash"), max(16, (hash_bytes * 8).bit_length() - 1)), "lengths": sorted(r["k"] for r in distinct.select("k").distinct().collect())}


class Finder:
    """Places of the windows whose hash is in the broadcast sets."""

    def __init__(self, sets: dict):
        self.sets, self.bitmap = sets, sets.get(0)
        self.lengths = sets["lengths"] if self.bitmap is not None else list(sets)
        self.first = {}
        if self.bitmap is None:
            for k, hashes in sets.items():
                seen = np.zeros(1 << BITS, bool)
                seen[(hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
                self.first[k] = seen

    def places(self, grams: np.ndarray, k: int) -> np.ndarray:
        if self.bitmap is not None:
            return np.flatnonzero(in_bitmap(self.bitmap, grams))
        at = np.flatnonzero(self.first[k][(grams & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        hashes = self.sets[k]
        return at[hashes[np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)] == grams[at]]


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        word, fold = tc.class_table(tc.ALNUM), tc.fold_table()
        for batch in batches:
            buf, offs = tc.text_bytes(batch.column("text"))
            n_words, hits = [], [[] for _ in range(batch.num_rows)]
            for a, b in tc.row_groups(offs):
                part = buf[offs[a] : offs[b]]
                h, s, e, rows = tc.words(part, offs[a : b + 1] - offs[a], word, fold)
                n_words += np.diff(rows).tolist()
                low = None
                for k in finder.lengths:
                    grams = tc.ngrams(h, k)
                    at = finder.places(grams, k) if len(grams) else grams
                    if not len(at):
                        continue
                    row = np.searchsorted(rows, at, "right") - 1
                    within = at + k <= rows[row + 1]
                    low = low if low is not None else fold[part].tobytes()
                    for i, r in zip(at[within].tolist(), row[within].tolist()):
                        own = b" ".join(low[s[j] : e[j]] for j in range(i, i + k)).decode()
                        hits[a + r].append({"k": k, "hash": int(grams[i].view(np.int64)), "at": i - int(rows[r]), "words": own})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n_words, pa.int64()), pa.array(hits, _HITS)], ["doc_id", "digest", "n_words", "hits"])

    return run


def _digest(text):
    return F.unhex(F.md5(text.cast("binary")))


def scan(docs: DataFrame, benchmark: DataFrame, hash_bytes: int = HASH_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, found): doc_id, digest, n_words of every row of docs(doc_id, text), and of every contaminated text

    digest, copies, windows (first word and length of each) and items (ids with a window there).
    """
    spark = docs.sparkSession
    byte_bound(spark)
    windows = windows_of(benchmark)
    sent = spark.sparkContext.broadcast(hash_sets(windows, hash_bytes))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _digest(text).alias("digest"))
    scanned = staged(rows.mapInArrow(_scan(sent), "doc_id long, digest binary, n_words long, hits array<struct<k:int,hash:long,at:long,words:string>>"), "scanned")
    texts = scanned.where(F.size("hits") > 0).groupBy("digest").agg(F.first("hits").alias("hits"), F.count("*").alias("copies"))
    window = ["k", "hash", "words"]
    hits = staged(texts.select("digest", "copies", F.explode("hits").alias("h")).select("digest", F.col("copies").alias("of"), "h.*").withColumn("key", F.struct(*window)), "hits")
    met = hits.groupBy("key").agg(F.count("*").alias("copies")).select("key", "copies", "key.*")
    met = staged(met.join(windows, window).groupBy("key", "copies").agg(F.collect_set("item_id").alias("ids")), "met")
    by_text = join_classes(hits, met).groupBy("digest").agg(F.first("of").alias("copies"), F.sort_array(F.collect_set(F.struct("at", "k"))).alias("windows"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("items"))
    return scanned.drop("hits"), staged(by_text, "found")


def report(docs: DataFrame, benchmark: DataFrame, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    rows, found = scan(docs, benchmark, hash_bytes)
    # windows come in order of their first word, so each adds the words beyond the furthest one so far
    step = lambda acc, w: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), w["at"] + w["k"] - F.greatest(acc["end"], w["at"]))).alias("n"), F.greatest(acc["end"], w["at"] + w["k"]).alias("end"))
    n_hit = F.aggregate("windows", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda acc: acc["n"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    facts = found.select("digest", "copies", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"))
    clean = rows.join(found.select("digest"), "digest", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(text_digest([])).alias("items_sha256"))
    hit = join_classes(rows.join(found.select("digest"), "digest", "left_semi"), facts, key="digest").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    return clean.unionByName(hit).withColumn("contaminated", F.col("n_hit") > 0)


def _boxed(docs: DataFrame) -> DataFrame:
    """All columns in one struct, so that no name can clash with those added here."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text.alias("text"), _digest(text).alias("digest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", hash_bytes: int = HASH_BYTES) -> DataFrame:
    """mode 'documents': rows that hold a window go.  mode 'spans': their hit words go, the rest of the text stays.

    Words on either side of a removed span may meet in a window that was not in the text; it is not looked for again.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    _, found = scan(docs, benchmark, hash_bytes)
    # texts the sieve turns away are surely clean and are not shuffled, however large the table of the others is
    perhaps, own = sieve(found, "digest")(F.col("digest")), found.select("digest")
    clean = _boxed(docs).where(~perhaps).unionByName(_boxed(docs).where(perhaps).join(own, "digest", "left_anti").select("_doc", "text", "digest")).select("_doc.*")
    if mode == "documents":
        return clean
    hit = join_classes(_boxed(docs).where(perhaps).join(own, "digest", "left_semi"), found.select("digest", "copies", "windows"), key="digest")
    cut = hit.mapInArrow(_cut, hit.schema)
    return clean.unionByName(cut.select(*[F.col("text").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, fold = re.compile(PATTERN), {c: c + 32 for c in range(65, 91)}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for r, windows in enumerate(batch.column("windows").to_pylist()):
            gone = {j for w in windows for j in range(w["at"], w["at"] + w["k"])}
            spans = [m.span() for i, m in enumerate(find.finditer(texts[r].translate(fold))) if i in gone]
            out, at = [], 0
            for s, e in spans:
                out.append(texts[r][at:s])
                at = e
            texts[r] = re.sub(r"[ \t]{2,}", " ", "".join(out) + texts[r][at:])
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def text_digest(ids: list[int]) -> str:
    """The digest `report` gives for these items."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
