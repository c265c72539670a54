"""Hash chains: one for each subject, which are written and verified in parallel, or one over all events in order."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import GENESIS
from ..lineage import cut


def _ordered(events: DataFrame, subject: str, order: str, envelope: str) -> DataFrame:
    return events.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("id"), F.col(envelope).alias("envelope")))).alias("e"))


def heads(events: DataFrame, subject: str, order: str, envelope: str) -> DataFrame:
    """Last hash of each chain: sha256 over the one before and the envelope, from the genesis hash."""
    fold = F.aggregate("e", F.lit(GENESIS), lambda a, x: F.sha2(F.concat(a, x["envelope"]), 256))
    return _ordered(events, subject, order, envelope).select(subject, fold.alias("head"), F.size("e").cast("long").alias("n"))


def entries(events: DataFrame, subject: str, order: str, envelope: str) -> DataFrame:
    """Every entry with its hash."""
    start = F.array(F.struct(F.lit(None).cast("long").alias("id"), F.lit("").alias("envelope"), F.lit(GENESIS).alias("hash")))
    grow = lambda acc, x: F.concat(acc, F.array(F.struct(x["id"].cast("long").alias("id"), x["envelope"].alias("envelope"), F.sha2(F.concat(F.element_at(acc, -1)["hash"], x["envelope"]), 256).alias("hash"))))
    kind = "array<struct<id:bigint,envelope:string,hash:string>>"
    chained = _ordered(events, subject, order, envelope).select(subject, F.aggregate("e", start.cast(kind), lambda a, x: grow(a, x).cast(kind)).alias("c"))
    return chained.select(subject, F.explode(F.slice("c", 2, F.size("c"))).alias("x")).select(subject, "x.*")


def verify(log: DataFrame, subject: str, order: str, envelope: str) -> DataFrame:
    """n, bad and first_bad for each chain: an entry is bad unless its hash follows from the one before and its envelope."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(subject).orderBy(order)), F.lit(GENESIS))
    marked = log.withColumn("ok", F.col("hash") == F.sha2(F.concat(before, F.col(envelope)), 256))
    return marked.groupBy(subject).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.min(F.when(~F.col("ok"), F.col(order))).alias("first_bad"))


def forks(log: DataFrame, prev: str, order: str) -> DataFrame:
    """Hashes that more than one entry claims to follow."""
    return log.groupBy(prev).agg(F.count("*").alias("n"), F.min(order).alias("min_id"), F.max(order).alias("max_id")).filter("n > 1")


def global_chain(events: DataFrame, order: str, envelope: str) -> DataFrame:
    """seq, id, envelope, prev, hash: one chain over all events. Each hash needs the one before, so this is one task's
    sequence, as a log with a lock is one writer's; it streams over events that many tasks have sorted, and holds a batch
    at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seq, top = GENESIS, 0, None
        for pdf in frames:
            if len(pdf) and top is not None and pdf["id"].iloc[0] < top:
                raise RuntimeError("sorted partitions came out of order")
            top = pdf["id"].iloc[-1] if len(pdf) else top
            prev = []
            hashes = []
            for text in pdf["envelope"]:
                prev.append(last)
                last = sha256((last + text).encode()).hexdigest()
                hashes.append(last)
            yield pdf.assign(seq=range(seq + 1, seq + 1 + len(pdf)), prev=prev, hash=hashes)[["seq", "id", "envelope", "prev", "hash"]]
            seq += len(pdf)

    rows = events.select(F.col(order).cast("long").alias("id"), F.col(envelope).alias("envelope"))
    return cut(rows.orderBy("id")).coalesce(1).mapInPandas(run, "seq long, id long, envelope string, prev string, hash string")


def verify_global(chain: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """n, first_bad, good_before, head: how far the chain holds. Entries are checked in parallel, each against its own
    envelope and against the hash of the entry before it, in stretches of sequence numbers that also get the entry before
    their first: so the chain is read once and isn't joined with itself."""
    on = F.floor(F.col("seq") / stretch)
    dealt = chain.withColumn("_on", F.explode(F.when(F.col("seq") % stretch == stretch - 1, F.array(on, on + 1)).otherwise(F.array(on)))).repartition("_on")  # from the one writer to many tasks
    order = Window.partitionBy("_on").orderBy("seq")
    stored = F.when(F.lag("seq").over(order) == F.col("seq") - 1, F.lag("hash").over(order))
    held = dealt.withColumn("stored", stored).filter(F.col("_on") == on)
    held = held.withColumn("ok", (F.col("prev") == F.coalesce("stored", F.lit(GENESIS))) & (F.col("hash") == F.sha2(F.concat("prev", "envelope"), 256)))
    first = F.min(F.when(~F.col("ok"), F.struct("seq", "id")))
    summed = held.agg(F.count("*").alias("n"), first.alias("bad"), F.max_by("hash", "seq").alias("head"))
    return summed.select("n", F.col("bad.id").alias("first_bad"), F.coalesce(F.col("bad.seq") - 1, F.col("n")).alias("good_before"), "head")
