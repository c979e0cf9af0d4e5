"""Token counts (op8) of whole texts, with overlap resynchronisation for huge ones.

A text of more than HUGE characters is encoded in chunks of CHUNK characters that
overlap.  Two neighbouring encodings are spliced at a boundary p in their overlap at
which both start a token and which is proven stable: a single space or other white
space at p after a character that is not white space.  No alternative of a byte-level
splitter takes white space after anything else, and it never looks back, so whatever
stands before, a piece starts at p, and both encodings go on alike from there (the
last pieces before a chunk's end, which its cut may change, lie after p).  Where an
overlap holds no such boundary it is doubled, up to the whole rest of the text.

By the same proof the other texts are counted piece by piece: a text falls apart at
every space after a character that is not white space, and the library encodes each
distinct piece once per worker (a full cache lets its long, rare pieces go).

Defined cases: null or empty text has 0 bytes and 0 tokens; null doc_id stays null;
repeated rows are counted each.  Special tokens inside a text count as the library
counts them by default; none are added, and nothing is truncated or padded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_bound, worker_cache

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 15, 1 << 9
CACHED_PIECES, SHORT = 600_000, 10
PIECE = re.compile(r"(?<=\S)(?= )")
LATIN = re.compile(r"[ -~\n\u00a1-\u024f]*")
#: the byte-level splitter
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """The vocabulary's tokens in one piece of text.

    Where the definition is a plain byte-level BPE whose ids follow its merges, pieces
    of Latin text go through the faster of the two public libraries with the ranks read
    from the same definition; special tokens, other scripts and other definitions go
    through the definition's own library.  Both give the same tokens.
    """

    def __init__(self, definition: str):
        self.tokenizer = load(definition)
        self.known: dict[str, int] = {}
        self.fast = ranks_of(definition)

    def pieces(self, new: list[str]) -> None:
        slow = new
        if self.fast is not None:
            quick, slow = self.fast, []
            for p in new:
                if "<" in p or not LATIN.fullmatch(p):
                    slow.append(p)
                else:
                    self.known[p] = len(quick(p))
        if slow:
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            for p, e in zip(slow, encode(slow, add_special_tokens=False)):
                self.known[p] = len(e)


def ranks_of(definition: str):
    """An encoder over the definition's own ranks, or None if it is not of that kind."""
    import json

    made = json.loads(definition)
    model, before = made.get("model") or {}, made.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or made.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def load(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _starts(encoding, base: int) -> list[int]:
    return [base + s for s, _ in encoding.offsets]


def count_huge(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks; equal to encoding it whole."""
    total, a, n = 0, 0, len(text)
    own = None  # starts of the tokens of the chunk at a, from the last splice on
    b = min(n, chunk + overlap)
    own = _starts(tokenizer.encode(text[a:b], add_special_tokens=False), a)
    while b < n:
        a += chunk
        width = overlap
        while True:
            end = min(n, a + chunk + width)
            after = _starts(tokenizer.encode(text[a:end], add_special_tokens=False), a)
            both = set(after)
            # two pieces before the cut at b are left out: only they can depend on it
            at = next((p for p in own if a < p < b - 2 and p in both and text[p].isspace() and not text[p - 1].isspace() and any(text[i].isspace() for i in range(p + 1, b - 1))), None) if b < n else None
            if at is not None:
                break
            if b >= n:
                break
            width *= 2
            b = min(n, a + width)
            first = own[0] if own else a
            start = first
            own = _starts(tokenizer.encode(text[start:b], add_special_tokens=False), start)
        if at is None:
            return total + len(own)
        total += sum(p < at for p in own)
        own = [p for p in after if p >= at]
        b = end
    return total + len(own)


def pieces(text: str) -> list[str]:
    """The text cut at every space after a character that is not white space."""
    parts = text.split(" ")
    if all(parts) and not any(p[-1].isspace() for p in parts[:-1]):
        return [parts[0], *[" " + p for p in parts[1:]]]
    return PIECE.split(text)


def count_pieces(counter: Counter, text: str) -> int:
    """Tokens of a text as the sum over its pieces; equal to encoding it whole."""
    own, known = pieces(text), counter.known
    new = [p for p in set(own) if p not in known]
    if new:
        if len(known) + len(new) > CACHED_PIECES:
            longer = [p for p in known if len(p) > SHORT]
            if len(longer) < CACHED_PIECES // 2:
                longer = list(known)
            for p in longer:
                del known[p]
            new = [p for p in set(own) if p not in known]
        counter.pieces(new)
    return sum(map(known.__getitem__, own))


def _count(sent, huge: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition = sent.value
        cache = worker_cache()
        key = ("tokenizer", hash(definition))
        if key not in cache:
            cache[key] = Counter(definition)
        counter = cache[key]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [0] * len(texts)
            for i, t in enumerate(texts):
                counts[i] = count_huge(counter.tokenizer, t, chunk, overlap) if len(t) > huge else count_pieces(counter, t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.  vocabulary: path of a tokenizer's JSON file, read on the driver."""
    byte_bound(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file of a fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(sent, huge, chunk, overlap), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
