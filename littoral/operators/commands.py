"""Write commands as set operations: what is asked, which of it is allowed, and the table and log rows that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import disk


def canonical(**fields: Column) -> Column:
    """Compact JSON with sorted names; nulls stay as null, as in the form that digests are taken of."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def envelope(event: str, subject: str, key: Column, **payload: Column) -> Column:
    """What an audit entry is the digest of: event, subject and payload, names in order."""
    body = F.struct(*(payload[k].alias(k) for k in sorted(payload)))
    return canonical(event_type=F.lit(event), payload=body, subject_id=key.cast("string"), subject_type=F.lit(subject))


def created(table: DataFrame, rows: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """The rows to append: those whose ``column`` is allowed and whose non-null ``key`` the table doesn't have, each key
    once (the row that sorts first). Rows without a key all pass."""
    good = rows.filter(F.col(column).isin(*allowed))
    names = [c for c in rows.columns if c != key]
    keyed = good.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*names)).alias("r")).select(key, "r.*")
    new = keyed.join(table.select(key).distinct(), key, "left_anti").select(*rows.columns)
    return new.unionByName(good.filter(F.col(key).isNull()))


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def subscribed(table: DataFrame, asks: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Subscriptions after requests (key, row, col, lang): a request replaces the fence, all cells within k steps, and the
    language of its key, or adds it."""
    latest = asks.groupBy(key).agg(F.max(F.struct("t", "row", "col", "lang")).alias("r")).select(key, "r.row", "r.col", "r.lang")
    fenced = latest.select(key, "lang", disk(F.col("row"), F.col("col"), k).alias("cells"))
    return deleted(table.select(key, "lang", "cells"), fenced, key).unionByName(fenced)


def crosslinked(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """people (id, kind, status) after pairs (id, partner) were resolved: both rows are linked and resolved if both are
    there, open, and of opposite kinds. Of several commands on one person the least partner counts, and both must have
    chosen each other's command."""
    one = people.select("id", "kind", "status")
    other = people.select(F.col("id").alias("partner"), F.col("kind").alias("kind2"), F.col("status").alias("status2"))
    fit = pairs.join(one, "id").join(other, "partner").filter("status = 'open' AND status2 = 'open' AND kind <> kind2")
    both = fit.select("id", "partner").unionByName(fit.select(F.col("partner").alias("id"), F.col("id").alias("partner")))
    first = both.groupBy("id").agg(F.min("partner").alias("partner"))
    back = first.select(F.col("partner").alias("id"), F.col("id").alias("partner"))
    settled = first.join(back, ["id", "partner"], "left_semi")
    done = people.join(settled, "id", "left")
    return done.select("id", "kind", F.when(F.col("partner").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"), "partner")


def merged_narratives(stored: DataFrame, clusters: DataFrame) -> DataFrame:
    """Stored narratives after new clusters (cluster, narrative_id of the stored one it overlaps or null, n): a dismissed
    one is left alone, a draft takes the new facts and keeps its message and state, and a cluster of its own becomes a
    draft. Adds change."""
    facts = clusters.filter("narrative_id IS NOT NULL").groupBy("narrative_id").agg(F.max("n").alias("new_n"))
    old = stored.join(facts, "narrative_id", "left")
    refreshed = (F.col("status") == "draft") & F.col("new_n").isNotNull()
    change = F.when(refreshed, "refreshed").when(F.col("new_n").isNotNull(), "skipped").otherwise("kept")
    old = old.select("narrative_id", "status", F.when(refreshed, F.col("new_n")).otherwise(F.col("n")).alias("n"), change.alias("change"))
    new = clusters.filter("narrative_id IS NULL").select(F.col("cluster").alias("narrative_id"), F.lit("draft").alias("status"), "n", F.lit("created").alias("change"))
    return old.unionByName(new)


def tiled(runs: DataFrame, order: str, key: list[str]) -> DataFrame:
    """Adds period_start: each run's period begins where the one before it ended, so periods tile time without gaps."""
    w = Window.partitionBy(*key).orderBy(order)
    return runs.withColumn("period_start", F.lag(order).over(w))


def anomaly_life(scores: DataFrame, keys: list[str], z: float, stale: int) -> DataFrame:
    """keys, t, z, state: what each score (keys, t, z) does to its series' anomaly. It opens at |z| >= z, is refreshed
    while that lasts, is resolved by the next score below, and has expired if the series was silent for longer than
    ``stale`` before the score. Scores that change nothing are left out."""
    w = Window.partitionBy(*keys).orderBy("t")
    high = F.coalesce(F.abs(F.col("z")) >= z, F.lit(False))
    seen = scores.withColumns({"_high": high, "_was": F.coalesce(F.lag(high).over(w), F.lit(False)), "_silent": F.coalesce(F.col("t") - F.lag("t").over(w) > stale, F.lit(False))})
    open_before = F.col("_was") & ~F.col("_silent")
    state = (
        F.when(F.col("_high") & open_before, "refreshed")
        .when(F.col("_high") & F.col("_was"), "expired,opened")
        .when(F.col("_high"), "opened")
        .when(open_before, "resolved")
        .when(F.col("_was"), "expired")
    )
    return seen.withColumn("state", state).filter(F.col("state").isNotNull()).select(*keys, "t", "z", "state")
