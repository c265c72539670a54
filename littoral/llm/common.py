"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir where it is set. In local mode alone (tests) an unset one becomes a
    new temporary folder; on a cluster that is an error, since executors share no local folders."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder, so lost executors cost no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a table of intermediate rows that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver notice that what made a checkpoint is no longer referenced: Spark then deletes its shuffle files,
    which otherwise stay on the executors' disks until the driver happens to collect garbage."""
    for _ in range(2):  # what the first round lets go may hold more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Rows that hold whole texts go to Python workers in batches of at most so many, which bounds memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def draw(name: str, *keys: str) -> Column:
    """A number from 0 to 1 that depends on the keys alone, with 53 bits: a sample's bound holds for any number of rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(name), *keys), 11) / float(1 << 53)


#: What tells rows of documents apart while their texts are elsewhere: rows equal in both columns are equal in doc_id too.
ROW = ["doc", "row"]


def row_key() -> list[Column]:
    """The columns ROW: doc_id (0 for null) and a hash of doc_id and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64("doc_id", "text").alias("row")]


def join_counted(rows: DataFrame, stats: DataFrame, key: list[str], count: str = "n", ways: int = 256) -> DataFrame:
    """rows joined with stats, which has one row for each key and says how many rows there are with it.

    A key with more than 1/ways of all counted rows is one of fewer than ``ways``: these few go out by broadcast, so no
    task gets a hot key's rows. All other keys meet in a shuffle. Both inputs should be checkpointed.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(1, total // ways)
    few = F.broadcast(stats.filter(hot))
    rest = rows.join(F.broadcast(stats.filter(hot).select(*key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(stats.filter(~hot), key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def small(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task returns at once stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
