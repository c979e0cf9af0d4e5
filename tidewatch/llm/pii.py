"""Personal data (op9): base patterns plus bootstrapped contextual extraction.

Base patterns find emails, IPv4 addresses, payment cards and phone numbers in whole
texts; assignments to names that ask for a secret, and keys of published forms, are seeds of the
kind `secret`.  All of them seed the bootstrap: an occurrence is an identifier-like token (a run of
identifier characters with at least MIN_DIGITS digits, or a seed), and its lexical patterns are
  the token before it; with the one before that; at the start of a line; with the sign between
  (a colon, an equals sign, a number sign); the tokens on both sides; and its own prefix of
  letters.  Tokens are whole words, however long, with digits masked, or single signs.
On the graph of patterns and instances Spark alternates
  pattern score  = mean confidence over the pattern's distinct instances, per kind,
  instance score = 1 - product of (1 - score) over its trusted patterns,
for ROUNDS rounds; seeds keep confidence 1 for their own kind.  A pattern is trusted
with MIN_SUPPORT distinct confident instances and a score of MIN_SCORE.  Occurrences
of trusted patterns that no seed matched are added as spans of the pattern's
kind; base spans always stay.

Spans are held by text (a 128-bit digest), so copies are resolved once and rows without a
doc_id are treated like others.

Defined cases: null or empty text has no spans (the digest of the empty string); a
null doc_id stays null and its text still counts; repeated rows are reported each
but their instances count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_bound, staged
from .graph import left_classes

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
ROUNDS, MIN_SUPPORT, MIN_SCORE, MIN_DIGITS = 3, 8, 0.8, 5
LIGHT_PATTERNS = 100_000

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9@._%+#/-]+")
WORD = re.compile(r"\w")
#: a value after a sign, the name it is assigned to, and keys of published forms
ASSIGNED = re.compile(r"[=:][ \t]*[\"']?([A-Za-z0-9_+/=.-]{11,}[A-Za-z0-9=])")
SECRET_NAME = re.compile(r"(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,8}\Z", re.I)
KEY_FORM = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})\b")
PREFIX = re.compile(r"[a-z]{2,}[-_#/]?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = []
    at = text.find("@")
    while at >= 0:
        # a match lies within one run of its own characters, so runs can be searched alone
        start = at
        while start and EMAIL_RUN.match(text[start - 1]):
            start -= 1
        run = EMAIL_RUN.match(text, start)
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text, start, run.end())]
        at = text.find("@", run.end())
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """Seeds of the kind `secret`: values with a digit that a name or their form gives away."""
    out = [m.span(1) for m in ASSIGNED.finditer(text) if DIGIT.search(m[1]) and SECRET_NAME.search(text[max(0, m.start() - 24) : m.start()])] if "=" in text or ":" in text else []
    if "AKIA" in text or "gh" in text and "_" in text:
        out += [m.span() for m in KEY_FORM.finditer(text) if not any(s < m.end() and m.start() < e for s, e in out)]
    return [(BASE, s, e) for s, e in sorted(out)]


def seeds(text: str) -> list[tuple[int, int, int]]:
    """Base spans and secrets apart from them, by kind and start."""
    base = base_spans(text)
    return base + [x for x in secret_spans(text) if not any(s < x[2] and x[1] < e for _, s, e in base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _token_before(text: str, at: int) -> tuple[str, int]:
    """The word or sign before a place, digits masked, and its start; a line break is a token."""
    while at and text[at - 1] in " \t\"'(":
        at -= 1
    if not at:
        return "^", 0
    e = at
    if not WORD.match(text[at - 1]):
        return "^" if text[at - 1] in "\r\n" else text[at - 1], at - 1
    while at and WORD.match(text[at - 1]):
        at -= 1
    return DIGIT.sub("#", text[at:e].lower()), at


def _token_after(text: str, at: int) -> str:
    n = len(text)
    while at < n and text[at] in " \t\"')":
        at += 1
    if at == n or text[at] in "\r\n":
        return "$"
    s = at
    while at < n and WORD.match(text[at]):
        at += 1
    return DIGIT.sub("#", text[s:at].lower()) if at > s else text[s]


def _patterns(text: str, s: int, e: int) -> list[str]:
    one, at = _token_before(text, s)
    two, before = _token_before(text, at) if one != "^" else ("", 0)
    after = _token_after(text, e)
    out = []
    if one != "^":
        out += [f"< {one}", f"< {two} {one}", f"<> {one} _ {after}"]
        if one in ":=#" and two != "^":
            third = _token_before(text, before)[0]
            out.append(f"< {third} {two} {one}")
    prefix = PREFIX.match(text[s:e].lower())
    if prefix and s + prefix.end() < e:
        out.append("p " + prefix[0])
    return out


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind or None, start, end, instance, patterns) of seeds and other identifier-like tokens."""
    out = [(k, s, e, text[s:e].lower(), _patterns(text, s, e)) for k, s, e in spans]
    if DIGIT.search(text):
        taken = sorted((s, e) for _, s, e in spans)
        i = at = 0
        while m := DIGIT.search(text, at):
            s, e = m.start(), TOKEN.match(text, m.start()).end()
            while s > at and TOKEN.match(text[s - 1]):
                s -= 1
            at = e
            while e > s and text[e - 1] in "._%+#/-@":
                e -= 1
            if sum("0" <= c <= "9" for c in text[s:e]) < MIN_DIGITS:
                continue
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if not (i < len(taken) and taken[i][0] < e):
                out.append((None, s, e, text[s:e].lower(), _patterns(text, s, e)))
    return out


_OCC = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = "doc_id long, digest binary, spans array<struct<kind:int,start:long,end:long>>, occ array<struct<kind:int,start:long,end:long,instance:string,patterns:array<string>>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, occ = [], []
        for text in batch.column("text"):
            text = text.as_py()
            own = seeds(text) if text else []
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(own)])
            occ.append([{"kind": k, "start": s, "end": e, "instance": v, "patterns": p} for k, s, e, v, p in occurrences(text, own)] if text else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(spans, _SPANS), pa.array(occ, _OCC)], ["doc_id", "digest", "spans", "occ"])


def _digest(text):
    return F.unhex(F.md5(text.cast("binary")))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: digest of the text, seed spans and occurrences."""
    byte_bound(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _digest(text).alias("digest"))
    return staged(rows.mapInArrow(_find, FOUND), "pii")


def _light(rows: DataFrame) -> DataFrame:
    """Broadcast only where the table is proven small; it is joined beyond."""
    return F.broadcast(rows) if rows.count() <= LIGHT_PATTERNS else rows


def trusted_patterns(occ: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, kind, score) from occ(kind, instance, pattern), scored on the whole pattern-instance graph."""
    graph = staged(occ.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), "graph")
    total = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    conf = graph.where("seed is not null").select("pattern", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("conf"))
    trusted = None
    for _ in range(rounds):
        scored = conf.groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.sum((F.col("conf") >= min_score).cast("long")).alias("support")).join(total, "pattern")
        best = scored.groupBy("pattern").agg(F.max(F.struct(F.col("mass") / F.col("n"), -F.col("kind"), "support")).alias("x"))
        best = best.select("pattern", (-F.col("x")["col2"]).alias("kind"), F.col("x")["col1"].alias("score"), F.col("x.support").alias("support"))
        trusted = staged(best.where((F.col("support") >= min_support) & (F.col("score") >= min_score)).select("pattern", "kind", "score"), "trusted")
        held = graph.where("seed is null").join(_light(trusted), "pattern")
        # noisy-or over an instance's trusted patterns, as a sum of logarithms
        likely = held.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("conf"))
        more = graph.where("seed is null").join(likely, "instance").select("pattern", "instance", "kind", "conf")
        conf = graph.where("seed is not null").select("pattern", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("conf")).unionByName(more)
    return trusted


def discovered(found: DataFrame) -> DataFrame:
    """(digest, copies, more) for the texts with occurrences that only the bootstrap finds; staged."""
    texts = found.where(F.size("occ") > 0).groupBy("digest").agg(F.first("occ").alias("occ"), F.count("*").alias("copies"))
    occ = staged(texts.select("digest", "copies", F.explode("occ").alias("o")).select("digest", "copies", "o.*").withColumn("pattern", F.explode("patterns")).drop("patterns"), "occ")
    trusted = trusted_patterns(occ.select("kind", "instance", "pattern"))
    new = occ.where("kind is null").drop("kind").join(_light(trusted), "pattern")
    spans = new.groupBy("digest", "start", "end").agg(F.max("copies").alias("copies"), F.max(F.struct("score", -F.col("kind"))).alias("x")).select("digest", "copies", (-F.col("x")["col2"]).alias("kind"), "start", "end")
    return staged(spans.groupBy("digest").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more")), "more")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered, n_spans for every row of docs."""
    found = find(docs)
    rows = left_classes(found.select("doc_id", "digest", "spans"), discovered(found), "more")
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    n_discovered = F.when(F.col("more").isNull(), F.lit(0)).otherwise(F.size("more")).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS[:BASE])], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"), n_discovered.alias("n_discovered"), F.size(every).cast("long").alias("n_spans"))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, more in enumerate(batch.column("more").to_pylist()):
            text = texts[i]
            if not text:
                continue
            spans = seeds(text) + [(x["kind"], x["start"], x["end"]) for x in more or []]
            at, out = 0, []
            for s, e, k in sorted((s, e, k) for k, s, e in spans):
                if e > at:
                    out += [text[at : max(at, s)], f"[{KINDS[k].upper()}]" if s >= at else ""]
                    at = e
            if out:
                texts[i] = "".join(out) + text[at:]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; all rows and columns stay."""
    extra = discovered(find(docs))
    text = F.col("text").cast("string")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text.alias("text"), _digest(text).alias("digest"))
    rows = left_classes(boxed, extra, "more")
    done = rows.mapInArrow(_redact, rows.schema)
    return done.select(*[F.col("text").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
