"""What the two vector searches share: cleaning, dealing rows to buckets, exact scoring in blocks, merging top lists."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, draw, partitions


def clean(table: DataFrame, asking: str, drop_zero: bool) -> DataFrame:
    """rid, vec_id, v array<double>, asks: the rows of table (vec_id, embedding, others) that take part, checkpointed.

    Left out: null ids and vectors, empty vectors, null or non-finite components, and zero vectors if ``drop_zero``. A
    vector shorter than the longest one counts as filled up with zeros. Rows that share an id are rows of their own
    (rid tells them apart), even if they are equal. ``asking`` is the condition that makes a row a query too.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select("vec_id", v.alias("v"), F.coalesce(F.expr(asking), F.lit(False)).alias("asks"))
    rows = rows.filter("vec_id is not null and v is not null and size(v) > 0").filter(~bad)
    if drop_zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", "asks"))
    size = F.size("v")
    widest = rows.agg(F.max(size)).first()[0] or 0
    return rows.withColumn("v", F.when(size < widest, F.concat("v", F.array_repeat(F.lit(0.0), widest - size))).otherwise(F.col("v")))


def matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def deal(counts: dict[int, int], per_bucket: int, least: int) -> dict[int, list[int]]:
    """Cells to buckets of even size, at least ``least`` of them: a cell with more than ``per_bucket`` rows goes to
    several buckets, each of which gets a share of it."""
    total = sum(counts.values())
    n = max(least, -(-total // per_bucket))
    share = max(1, -(-total // n))
    heap = [(0, b) for b in range(n)]
    out: dict[int, list[int]] = {}
    for cell, rows in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        parts = -(-rows // share)
        taken = []
        for _ in range(min(parts, n)):
            load, b = heapq.heappop(heap)
            taken.append((load + rows // parts, b))
        for x in taken:
            heapq.heappush(heap, x)
        out[cell] = sorted(b for _, b in taken)
    return out


def spread(ids: np.ndarray, ways: int) -> np.ndarray:
    """An even share 0..ways-1 for each id, the same in every task."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % ways


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def partial_type(score: str) -> str:
    return f"rid long, query_id long, ids array<long>, scores array<{score}>"


def partial(rids: list[int], query_ids: list[int], ids: list[np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
    """A bucket's best rows of each query; a query is known by its rid, which its id may not be enough for."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in (ids, scores)]
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(query_ids, pa.int64()), *lists], ["rid", "query_id", "ids", "scores"])


def merge(partials: DataFrame, k: int, score: str) -> DataFrame:
    """Top lists of each query, one row for each bucket, to query_id, rank, vec_id, score."""
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, scores, out = None, [], [], []

        def finish() -> None:
            i, s = np.concatenate(ids), np.concatenate(scores)
            for rank, j in enumerate(best(i, s, k), 1):
                out.append((key[1], rank, i[j].item(), s[j].item()))

        for batch in batches:
            for r, q, i, s in zip(*(batch.column(c).to_pylist() for c in ("rid", "query_id", "ids", "scores"))):
                if (r, q) != key:
                    if ids:
                        finish()
                    key, ids, scores = (r, q), [], []
                ids.append(np.array(i, dtype=np.int64))
                scores.append(np.array(s, dtype=kind.to_pandas_dtype()))
                if len(ids) > 64:  # what can't be among the best goes now
                    a, b = np.concatenate(ids), np.concatenate(scores)
                    j = best(a, b, k)
                    ids, scores = [a[j]], [b[j]]
        if ids:
            finish()
        for n in range(0, len(out), 20_000):
            columns = zip(*out[n : n + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), kind))], ["query_id", "rank", "vec_id", "score"])

    ordered = partials.repartition(partitions(partials.sparkSession), "rid").sortWithinPartitions("rid")
    return ordered.mapInArrow(run, f"query_id long, rank int, vec_id long, score {score}")


def bucketwise(rows: DataFrame, work: Callable[[dict[str, np.ndarray], dict[str, list]], Iterator[pa.RecordBatch]], score: str, query_block: int = 1024) -> DataFrame:
    """Runs work(points, queries) for each bucket of rows (bucket, kind 0 for points or 1 for queries, rid, id, v, cells):
    a bucket's points come first and are held; its queries follow in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, points, state = None, [], None
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal state
            if waiting and points:
                if state is None:
                    state = {**{c: np.concatenate([p.column(c).to_numpy() for p in points]) for c in ("rid", "id")}, "v": np.concatenate([matrix(p.column("v")) for p in points]), "cells": [c for p in points for c in p.column("cells").to_pylist()]}
                t = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                yield from work(state, {"rid": t.column("rid").to_numpy(), "id": t.column("id").to_numpy(), "v": matrix(t.column("v")), "cells": t.column("cells").to_pylist()})
            waiting.clear()

        for batch in batches:
            keys = batch.column("bucket").to_numpy() * 2 + batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                b, kind = divmod(int(keys[lo]), 2)
                if b != bucket:
                    yield from flush()
                    bucket, points, state = b, [], None
                for k in range(lo, hi, query_block):
                    part = batch.slice(k, min(hi, k + query_block) - k)
                    if kind == 0:
                        points.append(part)
                    else:
                        waiting.append(part)
                        if sum(w.num_rows for w in waiting) >= query_block:
                            yield from flush()
        yield from flush()

    spark = rows.sparkSession
    return rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, partial_type(score))


def dealt(rows: DataFrame, kind: int, place: Callable[[np.ndarray, np.ndarray], list[dict[int, list[int]]]]) -> DataFrame:
    """(rid, vec_id, v) to rows for bucketwise(): place(rids, vectors) gives for each row its buckets and the cells meant there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                rids, column = b.column("rid").to_numpy(), b.column("v")
                where = place(rids, matrix(column))
                index = np.repeat(np.arange(len(rids)), [len(w) for w in where])
                if len(index):
                    buckets = [x for w in where for x in w]
                    cells = [c for w in where for c in w.values()]
                    columns = [pa.array(buckets, pa.int64()), pa.array(np.full(len(index), kind)), pa.array(rids[index]), b.column("vec_id").take(pa.array(index)), column.take(pa.array(index)), pa.array(cells, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "rid", "id", "v", "cells"])

    return rows.mapInArrow(run, "bucket long, kind long, rid long, id long, v array<double>, cells array<long>")


def sampled(rows: DataFrame, name: str, at_most: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About ``at_most`` rows, those with the lowest hash: rids, ids and vectors, on the driver."""
    got = rows.filter(draw(name, "rid") < min(1.0, at_most / max(1, total))).orderBy("rid").toArrow()
    if not got.num_rows:
        got = rows.orderBy("rid").limit(1).toArrow()
    column = got.column("v").combine_chunks()
    return got.column("rid").to_numpy(), got.column("vec_id").to_numpy(), matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
