"""Sharding along a Hilbert curve: rows that are near in several metadata dimensions land in the same shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2**bits (rows: points).

    By the published transform of the coordinates' bits to the curve's transposed index (J. Skilling, 2004).
    """
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << bits - 1
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ q - 1, flip)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def cut_points(meta: DataFrame, dim: str, bits: int) -> list:
    """Ascending values of a dimension that part all rows into up to 2**bits even buckets. Distinct values are counted and
    sorted by ranges; the driver gets a count for each partition and the values at the cuts alone."""
    values = meta.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))
    values = cut(values.repartitionByRange(partitions(meta.sparkSession), "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()))
    counts = sorted((r.part, r.n) for r in values.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total, before = sum(n for _, n in counts), {}
    so_far = 0
    for p, n in counts:
        before[p] = so_far
        so_far += n
    marks = np.array([total * k >> bits for k in range(1, 1 << bits)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if b.num_rows:
                at = before[b.column("part")[0].as_py()] if at is None else at
                ends = at + np.cumsum(b.column("n").to_numpy())
                begins = np.concatenate(([at], ends[:-1]))
                hit = np.searchsorted(marks, begins, "left") < np.searchsorted(marks, ends, "left")
                at = int(ends[-1])
                yield pa.RecordBatch.from_arrays([b.column("value").filter(pa.array(hit))], ["value"])

    return sorted(r.value for r in values.mapInArrow(run, T.StructType([values.schema["value"]])).collect())


def assign(docs: DataFrame, dims: list[str], key: str, shards: int = 40, bits: int = 5) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to docs: narrow rows, without texts.

    Rows are ordered by Hilbert index of their quantised dims (nulls in bucket 0), then by the other columns and
    ``key``, and the order is cut into runs whose lengths differ by at most one. Rows alike in every column are dealt
    in any order. The order is made by range partitions, so no task or driver sees all rows: the driver gets a count for
    each partition. A column named shard, slot or curve is replaced; fewer rows than shards leave shards empty.
    """
    meta = cut(docs.drop("shard", "slot", "curve"))
    columns = meta.columns
    total = meta.count()
    points = [np.array(cut_points(meta, d, bits)) for d in dims]

    @F.pandas_udf("long")
    def curve(*parts: pd.Series) -> pd.Series:
        places = np.zeros((len(parts[0]), len(parts)), dtype=np.int64)
        for j, (values, at) in enumerate(zip(parts, points)):
            there = values.notna().to_numpy()
            if len(at):
                places[there, j] = np.searchsorted(at, values[there].to_numpy(dtype=at.dtype), side="right")
            places[:, j] = places[:, j] * ((1 << bits) - 1) // max(1, len(at))  # few values take the whole range too
        return pd.Series(hilbert_index(places, bits))

    order = ["curve", *(c for c in columns if c != key), key]
    placed = meta.withColumn("curve", curve(*dims))
    ranged = placed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = docs.sparkSession.createDataFrame(offsets or [(-1, 0)], "part long, before long")
    rank = ranged.withColumn("part", part).join(F.broadcast(table), "part").withColumn("rank", F.col("before") + inside)
    shard = F.expr(f"rank * {shards} div {max(1, total)}")
    out = rank.withColumn("shard", shard)
    first = F.expr(f"(shard * {max(1, total)} + {shards - 1}) div {shards}")
    return out.select(*columns, "curve", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))


def write_shards(docs: DataFrame, dims: list[str], key: str, path: str, shards: int = 40) -> None:
    """Writes docs as one folder per shard, in slot order within files, so that readers prune by shard or by statistics.

    Rows that share a key, or have none, are told apart by a number of their own, so each is written once. Columns named
    shard, slot, curve or row_number are replaced.
    """
    docs = cut(docs.drop("shard", "slot", "curve", "row_number").withColumn("row_number", F.monotonically_increasing_id()))
    placed = assign(docs.select(*dict.fromkeys([*dims, key]), "row_number"), dims, key, shards)
    joined = docs.join(placed.select("row_number", "shard", "slot"), "row_number").drop("row_number")
    joined.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
