"""Stretches of words that repeat with a period, by the harmonic grid.

For each period p the positions jp and (j+1)p are compared: a run of period p is longer than the grid's step, so one of
its pairs lies on the grid. From such a pair the longest common extension ahead and back gives the whole run. Extensions
come from a suffix array, the suffix array of the reversed words, and range minima over their common prefix lengths.
The grid has n/1 + n/2 + ... = n log n pairs; a pair whose next few words differ can't lie in a run of the wanted length
and isn't looked up.

Documents are worked through a slice of texts at a time inside tasks: no shuffle, and a slice of many documents shares
one suffix array, in which separators that occur once end all matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import slices

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())]


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, one text after another; and the number of words of each text."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = split.flatten().dictionary_encode()
    index = flat.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    real = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, dtype=bool)
    return index[real], np.bincount(owner[real], minlength=len(texts))


class Extensions:
    """Longest common extensions ahead between positions of one sequence of numbers: suffix array, lengths of the common
    prefixes of its neighbours, and a table of minima over ranges of doubling length."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        names = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]  # names of blocks of 1, 2, 4, ... symbols
        order = np.argsort(names[0], kind="stable")
        while names[-1][order[-1]] < n - 1:
            step = 1 << (len(names) - 1)
            key = names[-1].astype(np.int64) * (n + 1)
            key[: n - step] += names[-1][step:].astype(np.int64) + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            name = np.empty(n, dtype=np.int32)
            name[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)))
            names.append(name)
        self.rank = names[-1]
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, dtype=np.int32)
        while names:
            name = names.pop()
            same = (name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)]) & (np.maximum(a, b) < n)
            width = 1 << len(names)
            common[same] += width
            a[same] += width
            b[same] += width
        self.least = [common]
        while (width := 1 << (len(self.least) - 1)) * 2 <= n - 1:
            self.least.append(np.minimum(self.least[-1][:-width], self.least[-1][width:]))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of different positions how many symbols agree from there on."""
        lo, hi = np.minimum(self.rank[x], self.rank[y]), np.maximum(self.rank[x], self.rank[y])
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(len(x), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << int(k))])
        return out


class RunFinder:
    """Runs in a slice of texts: words of all of them, one text after another, the longest text first."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, least: int, times: int) -> None:
        self.words, self.counts, self.least, self.times = words, counts, least, times
        self.ends = np.cumsum(counts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.inside: set[int] = set()
        self.found: list[np.ndarray] = []

    def equal_pairs(self, period: int) -> int:
        """At least how many neighbouring positions of a run equal those one period on."""
        return max(self.least - period, (self.times - 1) * period)

    def runs(self, at_most: int = 2_000_000) -> np.ndarray:
        """Rows of text, first word, length, period: sorted, each run with its smallest period."""
        probe = max(1, min(8, *(self.equal_pairs(p) - p + 1 for p in range(1, self.least + 1))))
        h = np.zeros(len(self.words), dtype=np.uint64)
        mixed = (self.words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for j in range(probe):
            h[: len(h) - j] = h[: len(h) - j] * np.uint64(0xBF58476D1CE4E5B9) + mixed[j:]
        held, size = [], 0
        live = len(self.counts)
        for period in range(1, int(self.counts.max(initial=0)) // self.times + 1):
            while self.counts[live - 1] < max(self.least, self.times * period):
                live -= 1
                if not live:
                    break
            if not live:
                break
            end = self.ends[live - 1]
            step = period * max(1, (self.equal_pairs(period) - probe + 1) // period)
            hits = np.flatnonzero(h[: end - period : step] == h[period:end:step]) * step
            if len(hits):
                hits = hits[self.doc[hits] == self.doc[hits + period]]
                held.append(np.stack((hits, np.full(len(hits), period))))
                size += len(hits)
                if size > at_most:
                    self.extend(np.concatenate(held, axis=1))
                    held, size = [], 0
        if size:
            self.extend(np.concatenate(held, axis=1))
        return self.distinct()

    def extend(self, pairs: np.ndarray) -> None:
        x, period = pairs
        docs = np.unique(self.doc[x])
        if not self.inside.issuperset(docs.tolist()):
            self.inside = set(docs.tolist())
            top = int(self.words.max()) + 1
            first = self.ends[docs] - self.counts[docs]
            parts = [np.array([top])]
            for k, (d, lo) in enumerate(zip(docs, first), 1):  # a separator before, between and after the texts
                parts += [self.words[lo : self.ends[d]], np.array([top + k])]
            joined = np.concatenate(parts)
            self.total = len(joined)
            self.shift = np.zeros(len(self.counts), dtype=np.int64)  # from a place among all words to one in joined
            self.shift[docs] = 1 + np.arange(len(docs)) + np.cumsum(self.counts[docs]) - self.counts[docs] - first
            self.ahead, self.back = Extensions(joined), Extensions(joined[::-1].copy())
        y = x + self.shift[self.doc[x]]
        ahead = self.ahead(y, y + period)
        back = self.back(self.total - y, self.total - y - period)
        length = back + period + ahead
        long = length >= np.maximum(self.least, self.times * period)
        x, back, length, period = x[long], back[long], length[long], period[long]
        start = x - back - (self.ends - self.counts)[self.doc[x]]
        self.found.append(np.stack((self.doc[x], start, length, period), axis=1))
        self.found = [self.distinct()]

    def distinct(self) -> np.ndarray:
        """A run shows at each multiple of its period, with the same ends: the smallest stays."""
        rows = np.concatenate(self.found) if self.found else np.zeros((0, 4), dtype=np.int64)
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        return rows[new]


def runs_of(texts: pa.Array, least: int, times: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The number of words of each text, and by number of the text its runs: rows of start, length, period."""
    words, counts = word_numbers(texts)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    rows = RunFinder(words[at], sizes, least, times).runs()
    edges = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))) if len(rows) else []
    found = {int(order[part[0, 0]]): part[:, 1:] for part in np.split(rows, edges[1:])} if len(rows) else {}
    return counts, found


def collapsed(text: bytes, runs: np.ndarray | None) -> bytes:
    words = text.split()
    if runs is not None:
        turn = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
        np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
        words = compress(words, np.cumsum(turn[:-1]) == 0)
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Adds n_words, runs, best and collapsed to docs (text, any others).

    Words are what lies between ASCII white space. A run is a stretch of at least ``least`` words and ``times`` periods
    in which words one period apart are equal, as long as it can be; its period is its smallest. ``runs`` are sorted by
    start, then period. ``best`` has the greatest length/period, compared exactly (ties: smallest start, then period),
    null without runs. ``collapsed`` is the words, joined by one space, without those that a run holds beyond its first
    period. Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged each by itself, so
    repeated rows and ties of any column make no difference. Very long texts take memory in proportion to n log n of
    their n words. Columns of these names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(*(f.name for f in ADDED))
    schema = T.StructType([*docs.schema, *ADDED])
    names = docs.columns
    run_type = pa.struct([(c, pa.int64()) for c in RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at_most=4_000_000):
                counts, found = runs_of(b.column("text"), least, times)
                raw = b.column("text").cast(pa.binary()).to_pylist()
                lists, best, texts = [], [], []
                for k, text in enumerate(raw):
                    rows = found.get(k)
                    rows_here = [] if rows is None else [dict(zip(RUN.names, r)) for r in rows.tolist()]
                    lists.append(rows_here)
                    best.append(min(rows_here, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None))
                    texts.append(collapsed(text or b"", rows))
                added = [pa.array(counts.astype(np.int64)), pa.array(lists, pa.list_(run_type)), pa.array(best, run_type), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *added], schema.names)

    return docs.mapInArrow(run, schema)
