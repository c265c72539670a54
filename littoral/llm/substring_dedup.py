"""Exact substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the least hash among its runs of ``mer`` words, so equal
windows have equal minimisers. Consecutive windows of a document that share a minimiser form a super-k-mer. One whose
minimiser stands in one place only holds no repeated window and stays where it is; each other one travels as one packed
string to the minimiser's bucket, where the windows of all strings are sorted and those that start in more than one
place counted. Words under such a window are removed.

Buckets that would hold more than a fair share of a task don't get strings: their windows are counted by 128-bit digest
with map-side sums, and the repeated digests are joined back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, cut, drop_folder, ensure_checkpoint_dir, free_shuffles, partitions, row_key
from .words import hashed, slices

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_PLACE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])


def squeezed(rows: DataFrame) -> DataFrame:
    """The same rows with their texts compressed, each by itself: shuffles of whole texts take two thirds of the disk."""
    schema = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = pa.array([None if t is None else compress(t) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else b.column(c) for c in schema.names], schema.names)

    return rows.mapInArrow(run, schema)


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a compressed text: maximal runs of bytes other than space and \\x09 to \\x0D, as bytes.split() has it."""
    return zstandard.decompress(text).split() if text else []


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def super_kmers(texts: pa.Array, width: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each super-k-mer: the number of its text, its first word there, its number of windows, its minimiser, and
    in how many of its places the minimiser stands."""
    h, counts = hashed(texts)
    n = len(h) - mer + 1
    span = width - mer + 1
    if n < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    mers = np.zeros(n, dtype=np.uint64)
    for j, power in enumerate(_powers(_PRIME, mer)):
        mers += h[j : j + n] * power
    mers ^= mers >> np.uint64(31)
    mers *= np.uint64(0xBF58476D1CE4E5B9)
    mers ^= mers >> np.uint64(29)
    low, step = mers, 1
    while step * 2 <= span:  # minima over spans of doubling length, then the overlap of two of them
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(low)]
    valid = np.arange(len(low)) + width <= ends[doc]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new & valid)
    bound = np.flatnonzero(np.concatenate((new | ~valid, [True])))
    lengths = bound[np.searchsorted(bound, starts, side="right")] - starts
    of = doc[starts]
    if not len(starts):
        return of, starts, lengths, starts, starts
    covered = lengths + span - 1
    first = np.cumsum(covered) - covered
    at = np.arange(covered.sum()) - np.repeat(first - starts, covered)
    times = np.add.reduceat((mers[at] == np.repeat(low[starts], covered)).astype(np.int64), first)
    return of, starts - (ends - counts)[of], lengths, low[starts].view(np.int64), times


def _references(rows: DataFrame, width: int, mer: int) -> DataFrame:
    """Every super-k-mer as bucket, doc, row, start, n, times: no words yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                of, start, n, bucket, times = super_kmers(b.column("text"), width, mer)
                rows = (pa.array(b.column(c).to_numpy()[of]) for c in ROW)
                columns = [pa.array(bucket), *rows, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32))]
                whole = pa.RecordBatch.from_arrays(columns, ["bucket", *ROW, "start", "n", "times"])
                for k in range(0, whole.num_rows, 50_000):
                    yield whole.slice(k, 50_000)

    return rows.mapInArrow(run, "bucket long, doc long, row long, start int, n int, times int")


def _packed(texts: DataFrame, width: int) -> DataFrame:
    """bucket, packed string, and the places where it stands: equal strings of a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                where: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
                for doc, row, text, refs in zip(*(b.column(c).to_pylist() for c in (*ROW, "text", "refs"))):
                    words = split_words(text)
                    for r in refs:
                        if not r["hot"]:
                            key = r["bucket"], b" ".join(words[r["start"] : r["start"] + r["n"] + width - 1])
                            where.setdefault(key, []).append((doc, row, r["start"]))
                columns = [pa.array([k[0] for k in where], pa.int64()), pa.array([k[1] for k in where], pa.binary())]
                columns.append(pa.array([np.array(p, dtype=_PLACE).tobytes() for p in where.values()], pa.binary()))
                out = pa.RecordBatch.from_arrays(columns, ["bucket", "packed", "places"])
                for k in range(0, out.num_rows, 10_000):
                    yield out.slice(k, 10_000)

    return texts.mapInArrow(run, "bucket long, packed binary, places binary")


def repeated_windows(strings: list[bytes], weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of these strings start more than once in all, each string counted ``weights`` times.

    Returns the string's number and the window's place in it, and marks. Windows are sorted by a 64-bit rolling hash;
    windows of equal hash are then compared word by word, so the counts are exact.
    """
    split = [s.split(b" ") for s in strings]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    flat = [w for s in split for w in s]
    number = {w: i for i, w in enumerate(set(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
    codes = np.random.default_rng(7).integers(0, 1 << 64, len(number), dtype=np.uint64)[ids]
    windows = lengths - width + 1
    owner = np.repeat(np.arange(len(strings)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (np.cumsum(lengths) - lengths)[owner] + inside
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * _powers(_PRIME, len(codes)), dtype=np.uint64)))
    h = (sums[start + width] - sums[start]) * _powers(_INVERSE, len(codes))[start]
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = h[order][1:] != h[order][:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights[owner[order]])
    marks = total[group] > 1
    lead = np.flatnonzero(new)[group]
    check = np.flatnonzero(marks & ~new)
    if len(check):
        same = np.ones(len(check), dtype=bool)
        a, b = start[order[check]], start[order[lead[check]]]
        for j in range(width):
            same &= ids[a + j] == ids[b + j]
        for g in np.unique(group[check[~same]]):  # two different windows of one hash: count them by their words
            members = np.flatnonzero(group == g)
            keys = [tuple(ids[start[order[m]] : start[order[m]] + width].tolist()) for m in members]
            seen: dict[tuple, float] = {}
            for key, m in zip(keys, members):
                seen[key] = seen.get(key, 0) + weights[owner[order[m]]]
            marks[members] = [seen[key] > 1 for key in keys]
    out = np.zeros(len(order), dtype=bool)
    out[order] = marks
    return owner, inside, out


def _count_bucketwise(packed: DataFrame, width: int) -> DataFrame:
    """doc, row, start, stop: the words of each row that lie under repeated windows, from partitions sorted by bucket."""

    def ranges(buckets: np.ndarray, strings: list[bytes], places: list[bytes]) -> pa.RecordBatch:
        weights = np.array([len(p) // _PLACE.itemsize for p in places])
        owner, inside, marks = repeated_windows(strings, weights, width)
        first = marks.copy()
        first[1:] &= ~(marks[:-1] & (owner[1:] == owner[:-1]))
        last = marks.copy()
        last[:-1] &= ~(marks[1:] & (owner[1:] == owner[:-1]))
        begin, end, of = inside[first], inside[last] + width, owner[first]
        spots = np.frombuffer(b"".join(places[i] for i in of), dtype=_PLACE)
        times = weights[of]
        start = spots["start"].astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(spots[c].astype(np.int64)) for c in ROW), pa.array(start + np.repeat(begin, times)), pa.array(start + np.repeat(end, times))], [*ROW, "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes], list[bytes]]] = []
        for b in batches:
            if not b.num_rows:
                continue
            bucket, strings, places = b.column("bucket").to_numpy(), b.column("packed").to_pylist(), b.column("places").to_pylist()
            at = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if at or held and held[-1][0][-1] != bucket[0]:
                held.append((bucket[:at], strings[:at], places[:at]))
                yield ranges(np.concatenate([x[0] for x in held]), [s for x in held for s in x[1]], [p for x in held for p in x[2]])
                held = []
            held.append((bucket[at:], strings[at:], places[at:]))
        if held:
            yield ranges(np.concatenate([x[0] for x in held]), [s for x in held for s in x[1]], [p for x in held for p in x[2]])

    return packed.mapInArrow(run, "doc long, row long, start long, stop long")


def _hot_windows(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, docs, rows, starts = [], [], [], []
            for doc, row, text, refs in zip(*(b.column(c).to_pylist() for c in (*ROW, "text", "refs"))):
                words = split_words(text)
                for r in refs:
                    if r["hot"]:
                        for s in range(r["start"], r["start"] + r["n"]):
                            digests.append(xxhash.xxh128_digest(b" ".join(words[s : s + width])))
                            docs.append(doc)
                            rows.append(row)
                            starts.append(s)
            out = pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(pa.array(x, pa.int64()) for x in (docs, rows, starts))], ["digest", *ROW, "start"])
            for k in range(0, out.num_rows, 10_000):
                yield out.slice(k, 10_000)

    return texts.mapInArrow(run, "digest binary, doc long, row long, start long")


def repeated_ranges(docs: DataFrame, width: int = 35, mer: int = 6, share: float = 0.25) -> DataFrame:
    """doc, row, ranges: for each row with repeated windows, the word ranges (start, stop) that they cover, unsorted.

    A bucket is hot if it holds more than ``share`` of a partition's fair share of super-k-mers.
    """
    spark = docs.sparkSession
    rows = docs.select(*row_key(), "text")
    path = f"{ensure_checkpoint_dir(spark)}/super-k-mers-{uuid.uuid4().hex}"
    _references(rows, width, mer).write.parquet(path)
    refs = spark.read.parquet(path)
    least = max(32.0, refs.count() * share / partitions(spark))
    counts = refs.groupBy("bucket").agg(F.sum("times").alias("times"), F.count("*").alias("n")).filter("times > 1")
    repeated = cut(counts.select("bucket", (F.col("n") > least).alias("hot")))
    del counts
    free_shuffles(spark)
    wanted = refs.join(repeated, "bucket").groupBy(*ROW).agg(F.collect_set(F.struct("start", "n", "bucket", "hot")).alias("refs"))
    texts = wanted.join(squeezed(rows), ROW)
    found = _count_bucketwise(_packed(texts, width).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket"), width)
    if not repeated.filter("hot").isEmpty():
        windows = _hot_windows(texts, width)
        often = cut(windows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
        free_shuffles(spark)
        found = found.unionByName(windows.join(often, "digest").select(*ROW, "start", (F.col("start") + width).alias("stop")))
    ranges = cut(found.groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("ranges")))
    drop_folder(spark, path)
    return ranges


def remove_repeats(docs: DataFrame, width: int = 35, mer: int = 6) -> DataFrame:
    """Adds kept (the words that stay, joined by one space), n_words and n_removed to docs (doc_id, text, any others).

    A word goes if a window over it also starts anywhere else, in the same document or another; windows are judged on
    the input. Null texts have no words and give an empty ``kept``. Rows equal in doc_id and text repeat each other and
    lose the same words. Columns named kept, n_words, n_removed, doc, row or ranges are replaced.
    """
    docs = docs.drop("kept", "n_words", "n_removed", *ROW, "ranges")
    found = repeated_ranges(docs, width, mer)
    free_shuffles(docs.sparkSession)
    joined = squeezed(docs.select("*", *row_key())).join(found, ROW, "left").drop(*ROW)
    schema = T.StructType([*docs.schema, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, counts, removed, texts = [], [], [], []
            for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist()):
                texts.append(zstandard.decompress(text) if text else None)
                words = (texts[-1] or b"").split()
                out, at = [], 0
                for r in sorted(ranges or (), key=lambda r: r["start"]):
                    if r["start"] > at:
                        out += words[at : r["start"]]
                    at = max(at, r["stop"])
                out += words[at:]
                kept.append(b" ".join(out).decode())
                counts.append(len(words))
                removed.append(len(words) - len(out))
            whole = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(whole if c == "text" else b.column(c) for c in names), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)
