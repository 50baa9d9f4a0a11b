"""Periodic runs of words by suffix-tree longest common extensions.

A run is a stretch of words with smallest period q, of at least ``max(min_length, 2q)``
words, that no neighbouring word extends keeping the period.  Per document:

1. Suffix trees (Ukkonen) of the word numbers and of their reversal.  An Euler tour with
   a block-decomposed range minimum gives the depth of two leaves' lowest common ancestor
   in constant time, that is, how far two positions agree forwards (or, in the reversed
   tree, backwards).
2. Lyndon roots: under an order of the words and under the reversed order the longest
   Lyndon word at each position ends at the next smaller suffix.  Each run has such a
   root under one of the two orders, so the 2n candidates, each extended both ways, give
   all runs; a Lyndon word has no border, so its length is the smallest period.

Only stretches that can hold a run get trees.  In a run of L words with period q, at
least L - q >= ``min_length`` / 2 words stand q words before an equal word, so each
stretch of that many words of the run occurs twice within it.  Words outside such
repeats are in no run, and a run cannot end at the edge of a stretch that goes on: the
pruning is exact, whatever hashes collide (a collision only keeps words).

Rows are independent: one pass, no shuffle.  A document is one task's; the trees take
about 0.5 kB for a word of the stretch at work.

Defined results: a null or empty text has no words, no runs and an empty collapsed text;
null ids and repeated rows each give a row; ties are kept as separate runs (two runs may
start at one word with different periods); an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
BLOCK = 32          # Euler-tour entries a block of the range minimum
OUT_ROWS = 256      # rows of an output batch, which holds whole texts
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (positive numbers) closed by the end mark 0, ready for extension queries."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.n, self.width = len(s), max(s) + 1
        start, stop, suffix, edges = self._grow(s)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys, kind="stable")
        self.child = child[order].tolist()
        bounds = np.searchsorted(keys[order], np.arange(len(start) + 1, dtype=np.int64) * self.width)
        self.low, self.high = bounds[:-1].tolist(), bounds[1:].tolist()
        self.marked = keys[order] % self.width == 0        # the edge that begins with the end mark
        self.suffix = np.array(suffix)
        self._tour(start, stop)

    def _grow(self, s: list[int]):
        n, width = self.n, self.width
        start, stop, link, suffix, edges = [0], [0], [0], [-1], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            last = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = edges.get(key)
                if below is None:
                    edges[key] = len(start)
                    start.append(i), stop.append(n), link.append(0), suffix.append(i - waiting + 1)
                    if last:
                        link[last], last = node, 0
                else:
                    begin, end = start[below], stop[below]
                    span = (end if end <= i else i + 1) - begin
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    cut = len(start)
                    start.append(begin), stop.append(begin + length), link.append(0), suffix.append(-1)
                    start.append(i), stop.append(n), link.append(0), suffix.append(i - waiting + 1)
                    edges[key] = cut
                    edges[cut * width + c] = cut + 1
                    start[below] = begin + length
                    edges[cut * width + s[begin + length]] = below
                    if last:
                        link[last] = cut
                    last = cut
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return start, stop, suffix, edges

    def _tour(self, start: list[int], stop: list[int]) -> None:
        child, at, high = self.child, self.low.copy(), self.high
        depth = [0] * len(start)
        tour, path = [0], [0]
        while path:
            v = path[-1]
            k = at[v]
            if k < high[v]:
                at[v] = k + 1
                c = child[k]
                depth[c] = depth[v] + stop[c] - start[c]
                tour.append(c)
                if at[c] == high[c]:
                    tour.append(v)
                else:
                    path.append(c)
            else:
                path.pop()
                if path:
                    tour.append(path[-1])
        visited = np.array(tour)
        leaves = np.flatnonzero(self.suffix[visited] >= 0)
        self.first = np.empty(self.n, np.int64)
        self.first[self.suffix[visited[leaves]]] = leaves
        self.rank = np.empty(self.n, np.int64)
        self.rank[self.suffix[visited[leaves]]] = np.arange(self.n)
        depths = np.array(depth)[visited]
        blocks = -(-len(depths) // BLOCK)
        self.depths = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        self.depths[:len(depths)] = depths
        grid = self.depths.reshape(blocks, BLOCK)
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= blocks:
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-step], top[step:]))

    def turned_rank(self) -> np.ndarray:
        """Ranks of the suffixes under the reversed order of symbols, the end mark still smallest."""
        child, low, high, marked = self.child, self.low, self.high, self.marked.tolist()
        suffix, rank, stack, k = self.suffix.tolist(), [0] * self.n, [0], 0
        while stack:
            v = stack.pop()
            a, b = low[v], high[v]
            if a == b:
                rank[suffix[v]] = k
                k += 1
            elif marked[a]:
                stack.extend(child[a + 1:b])
                stack.append(child[a])
            else:
                stack.extend(child[a:b])
        return np.array(rank)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j (i != j) agree on: the depth of their lowest common ancestor."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.behind[a], self.ahead[b])
        between = np.flatnonzero(y - x > 1)
        if len(between):
            lo, hi = x[between] + 1, y[between]            # whole blocks lo .. hi - 1
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at, row = between[level == k], self.levels[k]
                least = np.minimum(row[lo[level == k]], row[hi[level == k] - (1 << int(k))])
                out[at] = np.minimum(out[at], least)
        same = np.flatnonzero(x == y)
        if len(same):
            lo, hi = a[same], b[same]
            least = self.depths[lo]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.depths[np.minimum(lo + k, hi)])
            out[same] = least
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next later one of smaller rank; the last entry is the end mark's."""
    ranks, n = rank.tolist(), len(rank) - 1
    out, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of positive numbers, by start, then period."""
    n = len(symbols)
    if n < max(2, min_length):
        return []
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    i, found = np.arange(n), []
    for rank in (ahead.rank, ahead.turned_rank()):
        j = next_smaller(rank)
        right, left = ahead.extension(i, j), back.extension(n - i, n - j)
        period, begin, end = j - i, i - left, j + right
        good = (end - begin >= 2 * period) & (end - begin >= min_length)
        found.append(np.stack([begin, end - begin, period], axis=1)[good])
    return sorted({tuple(r) for r in np.concatenate(found).tolist()}, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """Stretches (start, stop) of words that can hold a run: covered by repeats of half a shortest run's words."""
    k, n = max(1, -(-min_length // 2)), len(hashes)
    if n < max(2, min_length):
        return []
    grams, rest = np.zeros(n - k + 1, np.uint64), hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        for x in range(k):
            grams = (grams + rest[x:n - k + 1 + x]) * _MIX
            grams ^= grams >> np.uint64(29)
    piece = np.zeros(len(grams), np.int64)
    where = np.arange(len(grams))
    bounds: list[tuple[int, int]] = []
    while True:
        # A gram counts if it recurs within the same stretch; stretches shrink until all their words are covered.
        order = where[np.lexsort((grams[where], piece[where]))]
        equal = (grams[order][1:] == grams[order][:-1]) & (piece[order][1:] == piece[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, order[twice], 1)
        np.add.at(cover, order[twice] + k, -1)
        alive = np.concatenate([[0], (np.cumsum(cover[:n]) > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(alive))
        now = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= min_length]
        if now == bounds or not now:
            return now
        bounds = now
        where = np.concatenate([np.arange(a, b - k + 1) for a, b in now])
        for p, (a, b) in enumerate(now):
            piece[a:b] = p


def document_runs(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    found = []
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    for a, b in stretches(hashes, min_length):
        numbers: dict[bytes, int] = {}
        symbols = [numbers.setdefault(w, len(numbers) + 1) for w in words[a:b]]
        found += [(a + s, length, q) for s, length, q in runs_of(symbols, min_length)]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period), collapsed (text without repeats)."""
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                counts, runs, texts = [], [], []
                for text in part.column(1).to_pylist():
                    words = text.encode().split()   # bytes split at the six ASCII blanks only
                    own = document_runs(words, min_length)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(b" ".join(collapse(words, own)).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(scan, f"doc_id {kind}, n_words bigint, "
                                 "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
