"""Reports and readings as streams: the same expressions as in batch, with watermarks and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.geo import square_cell
from .state import first_seen

REPORT = "client_key string, source string, external_id string, lat double, lon double, hazard_type string, text string, observed_at timestamp"
READING = "station_id string, variable string, time timestamp, value double"


def read_json(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def ingest(reports: DataFrame, now: Column | None = None, cell_degrees: float = 0.01) -> DataFrame:
    """Valid reports, once per client key (all of those without one, whose id comes from what they say), with what follows from the row alone: event time clamped to the last day,
    reporter, cell, hazard (a stated one is never replaced), urgency and hearsay. Clamping first means that the
    watermark of a day drops nothing."""
    now = F.current_timestamp() if now is None else now
    valid = reports.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    once = first_seen(valid.withColumn("created_at", scoring.clamp_observed(F.col("observed_at"), now)), "client_key", "created_at")
    row, col = square_cell(F.col("lat"), F.col("lon"), cell_degrees)
    guessed, _ = text.classify(F.col("text"))
    return once.select(
        F.sha2(F.concat_ws(":", "source", F.coalesce("client_key", F.to_json(F.struct("external_id", "lat", "lon", "hazard_type", "text", "observed_at")))), 256).alias("id"),
        F.sha2(F.concat_ws(":", "source", "external_id"), 256).alias("reporter_id"),
        "created_at", "lat", "lon", row.alias("row"), col.alias("col"),
        F.coalesce("hazard_type", guessed, F.lit("other")).alias("hazard_type"),
        text.urgency(F.col("text")).alias("urgency"), text.hearsay(F.col("text")).alias("hearsay"), "text",
    )


def hourly(readings: DataFrame, late: str = "8 days") -> DataFrame:
    """Rollup by station, variable and hour, kept up to date while late readings may still come; duplicates count once."""
    once = readings.withWatermark("time", late).dropDuplicates(["station_id", "variable", "time"])
    g = once.groupBy("station_id", "variable", F.window("time", "1 hour").alias("w"))
    return g.agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n")).select("station_id", "variable", F.col("w.start").alias("hour"), "avg", "min", "max", "n")


def batch_folder(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each micro-batch overwrites its own folder, so a batch that is run again isn't stored twice."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Everything that is there now, then stops; the next call goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(batch_folder(path, transform)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def telemetry_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of what messages did (``processors.STATION``): readings, stations as they are after the batch,
    registrations of new ones, and rejected messages, each in a folder of its own for each batch: one that is run again
    replaces what it left."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        taken = F.col("outcome").isin("registered", "updated")
        parts = {
            "readings": batch.select("station_id", F.explode("readings").alias("r")).select("station_id", "r.*").dropDuplicates(["station_id", "variable", "time"]),
            "rejected": batch.filter(~taken).select("id", "topic", "payload", F.col("outcome").alias("error")),
            "registered": batch.filter("outcome = 'registered'").select("station_id", "id", "name", "lat", "lon", "variables"),
            "stations": batch.filter(taken).groupBy("station_id").agg(F.max_by(F.struct("name", "lat", "lon", "variables", "id"), "id").alias("s")).select("station_id", "s.*"),
        }
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return write


def known_stations(spark: SparkSession, path: str) -> DataFrame:
    """All stations that sinks under ``path`` have left, as they were last: what a new checkpoint starts from."""
    s = spark.read.parquet(f"{path}/stations")
    return s.groupBy("station_id").agg(F.max_by(F.struct("name", "lat", "lon", "variables"), "id").alias("s")).select("station_id", "s.*")


def telemetry(raw: DataFrame, path: str, checkpoint: str, now: Column | None = None, known: DataFrame | None = None) -> None:
    """Takes all messages (id, topic, payload) that are there: decodes them, leads each station's state, and stores what
    came of it under ``path``."""
    from ..sources import iot
    from .processors import stations

    done = stations(iot.messages(raw, F.current_timestamp() if now is None else now), known)
    done.writeStream.foreachBatch(telemetry_sink(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def overloaded(progress: dict | None, most_rows: int = 500) -> bool:
    """Whether a query's last progress shows more unread rows than analytics should run beside."""
    if not progress:
        return False
    behind = 0
    for source in progress.get("sources", ()):
        metrics = source.get("metrics") or {}
        behind += int(metrics.get("numRowsOutstanding") or metrics.get("maxOffsetsBehindLatest") or 0)
    return behind > most_rows
