"""Names within an edit distance: a trie of a chunk of the list is walked with the rows of the distance table.

The names of a list share beginnings, so a row of the table is computed once for all that begin alike, and a
branch is left as soon as none of its names can come near enough.  The work follows what is near, not names times list.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Cells of distance rows, and rows of results, that are held at a time.
CELLS, OUT = 1 << 22, 1 << 16


def score_of(distance: int, longest: int) -> int:
    """The score of a distance, rounded as Spark's round() does."""
    return int(Decimal(repr((1 - distance / longest) * 100)).quantize(Decimal(1), ROUND_HALF_UP))


def _grouped(column: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different ASCII names in their order; the rows ordered by name, and where each name's rows begin."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = [x.encode() for x in coded.dictionary.to_pylist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), int)
    rank[order] = np.arange(len(names))
    of = rank[coded.indices.to_numpy()]
    return [names[i] for i in order], np.argsort(of, kind="stable"), np.r_[0, np.cumsum(np.bincount(of, minlength=len(names)))]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _trigrams(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of names that stand one after the other: (number, trigram), by number."""
    at = _ranges(np.r_[0, np.cumsum(size)[:-1]], np.maximum(size - 2, 0))
    x = text.astype(np.int64)
    both = _distinct(np.repeat(np.arange(len(size)), np.maximum(size - 2, 0)) << 24 | x[at] << 16 | x[at + 1] << 8 | x[at + 2])
    return both >> 24, both & 0xFFFFFF


class Listed:
    """A chunk of the list as a trie, level by level, and the trigrams of its names."""

    def __init__(self, table: pa.Table, min_score: int, share: float):
        self.ids, self.min_score, self.share = table["list_id"].combine_chunks(), min_score, share
        self.names, self.order, self.starts = _grouped(table["name"])
        self.size = size = np.array([len(x) for x in self.names])
        text, at = np.frombuffer(b"".join(self.names), np.uint8), np.r_[0, np.cumsum(size)[:-1]]
        self.levels, node, alive = [], np.zeros(len(size), int), np.arange(len(size))
        above = 1
        for depth in range(1, size.max() + 1):
            alive = alive[size[alive] >= depth]
            c, before = text[at[alive] + depth - 1], node[alive]
            new = np.r_[True, (c[1:] != c[:-1]) | (before[1:] != before[:-1])]
            first = np.flatnonzero(new)
            node[alive] = np.cumsum(new) - 1
            ends = alive[size[alive] == depth]
            name = np.full(len(first), -1)
            name[node[ends]] = ends
            many = np.bincount(before[first], minlength=above)
            self.levels.append((c[first], np.r_[0, np.cumsum(many)[:-1]], many, name, np.minimum.reduceat(size[alive], first), np.maximum.reduceat(size[alive], first)))
            above = len(first)
        of, grams = _trigrams(text, size)
        self.gram_n = np.bincount(of, minlength=len(size))
        self.gram_at = np.r_[0, np.cumsum(self.gram_n)[:-1]]
        self.known = _distinct(grams)
        self.grams = np.searchsorted(self.known, grams)
        # the most edits that the longer of two names allows, rounding included
        self.most = lambda longest: (longest * (1 - (min_score - 0.5) / 100) + 1e-9).astype(np.int32)

    def _near(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, name, distance) of queries of one length, a row of characters each."""
        n, length = asked.shape
        chars = np.ascontiguousarray(asked.T)
        rows = np.repeat(np.arange(length + 1, dtype=np.int32)[:, None], n, axis=1)
        stack = [(0, np.arange(n), np.zeros(n, int), rows)]
        while stack:
            depth, query, node, rows = stack.pop()
            if depth == len(self.levels):
                continue
            c, child, many, name, least, most = self.levels[depth]
            count = many[node]
            total = np.cumsum(count)
            if len(node) > 1 and total[-1] * (length + 1) > CELLS:
                half = min(max(1, int(np.searchsorted(total, total[-1] / 2))), len(node) - 1)
                stack += [(depth, query[:half], node[:half], rows[:, :half]), (depth, query[half:], node[half:], rows[:, half:])]
                continue
            depth, to, old = depth + 1, _ranges(child[node], count), np.repeat(np.arange(len(node)), count)
            query, c, low, high = query[old], c[to], least[to] - depth, most[to] - depth
            now = np.empty((length + 1, len(to)), np.int32)
            now[0] = depth
            bound = depth + np.maximum(0, np.maximum(length - high, low - length))
            last = rows[0][old]
            for j in range(1, length + 1):
                here = rows[j][old]
                x = now[j]
                np.add(last, chars[j - 1][query] != c, out=x)
                np.minimum(x, here + 1, out=x)
                np.minimum(x, now[j - 1] + 1, out=x)
                # what is left of one name and not of the other must still be paid
                bound = np.minimum(bound, x + np.maximum(0, np.maximum(length - j - high, low - (length - j))))
                last = here
            ends = np.flatnonzero((name[to] >= 0) & (now[length] <= self.most(np.maximum(length, depth))))
            if len(ends):
                yield query[ends], name[to[ends]], now[length][ends]
            live = np.flatnonzero((bound <= self.most(np.maximum(length, high + depth))) & (high > 0))
            if len(live):
                stack.append((depth, query[live], to[live], now[:, live]))

    def screen(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(entity_id, list_id, score) of the rows of a batch of names."""
        names, order, starts = _grouped(pa.chunked_array([batch["name"]]))
        size = np.array([len(x) for x in names])
        for length in np.unique(size):
            of = np.flatnonzero(size == length)
            for own in (of[i : i + 64] for i in range(0, len(of), 64)):
                asked = np.frombuffer(b"".join(names[i] for i in own), np.uint8).reshape(len(own), length)
                need, has = np.zeros(len(own), int), np.zeros((len(own), len(self.known)), bool)
                if length >= 4:  # shorter names meet the whole list
                    k, grams = _trigrams(asked.ravel(), size[own])
                    need = np.maximum(1, np.ceil(np.bincount(k, minlength=len(own)) * self.share)).astype(int)
                    place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
                    found = self.known[place] == grams
                    has[k[found], place[found]] = True
                for query, name, far in self._near(asked):
                    for i in range(0, len(query), OUT):
                        yield from self._rows(batch["entity_id"], own, order, starts, size, has, need, query[i : i + OUT], name[i : i + OUT], far[i : i + OUT])

    def _rows(self, entity_ids, own, order, starts, size, has, need, query, name, far) -> Iterator[pa.RecordBatch]:
        count = self.gram_n[name]
        shared = np.add.reduceat(has[np.repeat(query, count), self.grams[_ranges(self.gram_at[name], count)]].astype(int), np.r_[0, np.cumsum(count)[:-1]])
        longest = np.maximum(size[own[query]], self.size[name])
        pair = far.astype(np.int64) << 32 | longest
        pairs = _distinct(pair)
        score = np.array([score_of(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in pairs], np.int32)[np.searchsorted(pairs, pair)]
        kept = (shared >= need[query]) & (score >= self.min_score)
        query, name, score = own[query[kept]], name[kept], score[kept]
        a0, b0, nb = starts[query], self.starts[name], self.starts[name + 1] - self.starts[name]
        ends = np.cumsum((starts[query + 1] - a0) * nb)
        for i in range(0, int(ends[-1]) if len(ends) else 0, OUT):
            place = np.arange(i, min(i + OUT, int(ends[-1])))
            pair = np.searchsorted(ends, place, "right")
            place = place - np.where(pair > 0, ends[pair - 1], 0)
            a, b = order[a0[pair] + place // nb[pair]], self.order[b0[pair] + place % nb[pair]]
            yield pa.RecordBatch.from_arrays([entity_ids.take(pa.array(a)), self.ids.take(pa.array(b)), pa.array(score[pair], pa.int32())], ["entity_id", "list_id", "score"])


def screened(batches: Iterator[pa.RecordBatch], min_score: int, share: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, side, entity_id, list_id, name) ordered by part and side: the list's rows of a part, then its names, which stream."""
    part, listed, held = None, [], None
    for batch in batches:
        g, side = batch["part"].to_numpy(), batch["side"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (side[1:] != side[:-1])]) if len(g) else []
        for i, j in zip(cuts, np.r_[cuts[1:], len(g)]):
            rows = batch.slice(i, j - i)
            if g[i] != part:
                part, listed, held = g[i], [], None
            if side[i] == 0:
                listed.append(rows)
            elif listed:
                if held is None:
                    held = Listed(pa.Table.from_batches(listed), min_score, share)
                yield from held.screen(rows)
