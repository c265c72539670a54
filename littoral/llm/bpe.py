"""Byte-level BPE: corpus-level merge replay with an inverted index from token pair to word positions, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small
from .pretoken import CachedEncoder

#: One per worker process and vocabulary file, kept from task to task.
_ENCODERS: dict[str, tuple[MergeReplay, CachedEncoder]] = {}


class MergeReplay:
    """Applies the merges of a rank file to many words at once."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.first_pairs = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)
        self.made_by: dict[int, int] = {}  # pair of ids -> id of what it merges to, or -1

    def made(self, left: int, right: int) -> int:
        key = left << 24 | right
        rank = self.made_by.get(key)
        if rank is None:
            rank = self.made_by[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        todo = []
        for i, word in enumerate(raw):
            rank = self.ranks.get(word)
            if rank is None:
                todo.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        if todo:
            for i, ids in zip(todo, self._replay([raw[i] for i in todo])):
                out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> Iterator[bytes]:
        """All merges in rank order over the corpus of these words.

        The words lie end to end; position p holds a token id, or -1 once merged into its left neighbour. ``index``
        maps a token pair, named by the id of the token it makes, to the positions where it stands. Ranks are taken
        from a heap; a merge touches only the two neighbours, whose new pairs go into the index.
        """
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        pair = np.full(len(flat), -1, dtype=np.int64)
        pair[:-1] = self.first_pairs[flat[:-1] * 256 + flat[1:]]
        pair[ends - 1] = -1
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        ranks, starts = np.unique(pair[at], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(ranks, np.split(at, starts[1:]))}
        heap = list(index)
        heapify(heap)
        ids = self.byte_ids[flat].tolist()
        after = np.arange(1, len(flat) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(flat) - 1)
        before[np.concatenate(([0], ends[:-1]))] = -1
        after, before, made = after.tolist(), before.tolist(), self.made
        made_by, tokens, get_rank = self.made_by, self.tokens, self.ranks.get

        def finish(p: int) -> None:
            """Lowest rank first, leftmost first, for the one word around p: where a merge made a pair of lower rank."""
            while before[p] >= 0:
                p = before[p]
            while True:
                best, where, x = 1 << 60, -1, p
                while (y := after[x]) >= 0:
                    r = made(ids[x], ids[y])
                    if 0 <= r < best:
                        best, where = r, x
                    x = y
                if where < 0:
                    return
                q = after[where]
                n = after[where] = after[q]
                ids[where], ids[q] = best, -1
                if n >= 0:
                    before[n] = where

        while heap:
            rank = heappop(heap)
            places = index.pop(rank)
            places.sort()
            for p in places:
                if ids[p] < 0 or (q := after[p]) < 0 or made_by.get(ids[p] << 24 | ids[q], -2) != rank and made(ids[p], ids[q]) != rank:
                    continue  # a neighbour has merged with another since
                n = after[p] = after[q]
                ids[p], ids[q] = rank, -1
                lower = False
                if n >= 0:
                    before[n] = p
                    key = rank << 24 | ids[n]
                    r = made_by.get(key)
                    if r is None:
                        r = made_by[key] = get_rank(tokens[rank] + tokens[ids[n]], -1)
                    if r >= 0:
                        lower = r < rank
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heappush(heap, r)
                left = before[p]
                if left >= 0:
                    key = ids[left] << 24 | rank
                    r = made_by.get(key)
                    if r is None:
                        r = made_by[key] = get_rank(tokens[ids[left]] + tokens[rank], -1)
                    if r >= 0:
                        lower |= r < rank
                        if r in index:
                            index[r].append(left)
                        else:
                            index[r] = [left]
                            heappush(heap, r)
                if lower:
                    finish(p)
        if len(made_by) > 1_000_000:
            made_by.clear()
        left = np.array(ids, dtype=np.int64)
        kept = np.concatenate(([0], np.cumsum(left >= 0)))[ends] * 4
        data = left[left >= 0].astype("<u4").tobytes()
        begin = 0
        for end in kept.tolist():
            yield data[begin:end]
            begin = end


def _encoder(path: str) -> tuple[MergeReplay, CachedEncoder]:
    if path not in _ENCODERS:
        replay = MergeReplay(path)
        _ENCODERS[path] = replay, CachedEncoder(public_tokenizers.PATTERN, replay.encode_words, 225_000)
    return _ENCODERS[path]


def _without(schema: T.StructType, keep: list[str], new: T.StructField) -> T.StructType:
    return T.StructType([*(schema[c] for c in keep if c != new.name), new])


def encode(df: DataFrame, ranks_path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out`` array<int>: the ids of every whole text, as ``encode_ordinary`` gives them.

    Null and empty texts give an empty array; special tokens' strings are ordinary text. ``keep``: the columns to carry
    along, all by default; a column that is named ``out`` already is replaced. Rows are neither merged nor moved: no
    shuffle, so repeated rows and hot keys cost nothing extra, and an empty table gives an empty table.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = _without(df.schema, keep, T.StructField(out, T.ArrayType(T.IntegerType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = _encoder(ranks_path)[1]
        for batch in small(batches):
            ids = list(cached.encode(batch.column(text).to_pylist()))
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            column = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], [*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out`` binary: the bytes that the ids of each row stand for (null ids: no bytes)."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = _without(df.schema, keep, T.StructField(out, T.BinaryType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _encoder(ranks_path)[0].tokens.__getitem__
        for batch in small(batches):
            column = batch.column(ids)
            values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts, begin = [], 0
            for end in ends.tolist():
                texts.append(b"".join(map(token, values[begin:end].tolist())))
                begin = end
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.binary())], [*keep, out])

    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
