"""Sensor series from a tabledap server, or from its CSV in files, as a Python data source."""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def url(base: str, dataset: str, variables: list[str], station: str | None = None, since: str | None = None) -> str:
    """The request for these columns alone, with the station and the start time left to the server."""
    parts = [",".join(["time", *variables])]
    if station:
        parts.append(quote(f'station="{station}"', safe='="'))
    if since:
        parts.append(quote(f"time>={since}", safe="=>:"))
    return f"{base}/{dataset}.csvp?" + "&".join(parts)


def rows(text: str) -> Iterator[tuple[datetime, str, float]]:
    """(time, variable, value) of each number in the CSV: units go from the headers; rows without a readable time and
    cells without a number are left out."""
    reader = csv.reader(io.StringIO(text))
    header = [h.split(" (")[0].strip() for h in next(reader, [])]
    if "time" not in header:
        return
    at = header.index("time")
    for line in reader:
        try:
            time = datetime.fromisoformat(line[at].strip().replace("Z", "+00:00"))
        except (ValueError, IndexError):
            continue
        time = time if time.tzinfo else time.replace(tzinfo=timezone.utc)
        for name, cell in zip(header, line):
            if name in ("time", "station"):
                continue
            try:
                value = float(cell)
            except ValueError:
                continue
            if not math.isnan(value):
                yield time, name, value


class _Station(InputPartition):
    def __init__(self, station: str, place: str):
        self.station, self.place = station, place


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """A task for each station; ``stations`` is 'id=url-or-file;...'."""
        return [_Station(*s.split("=", 1)) for s in self.options["stations"].split(";") if s]

    def read(self, partition: _Station) -> Iterator[tuple]:
        try:
            if "://" in partition.place:
                with urlopen(partition.place, timeout=30) as got:
                    text = got.read().decode()
            else:
                with open(partition.place) as got:
                    text = got.read()
        except OSError:
            return  # a station that can't be reached has no readings this time
        for time, variable, value in rows(text):
            yield partition.station, variable, time, value


class Tabledap(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabledap"

    def schema(self) -> str:
        return "station_id string, variable string, time timestamp, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, stations: dict[str, str]) -> DataFrame:
    spark.dataSource.register(Tabledap)
    return spark.read.format("tabledap").option("stations", ";".join(f"{k}={v}" for k, v in stations.items())).load()


def unpivot(wide: DataFrame, keys: list[str]) -> DataFrame:
    """A wide table of variables to (keys, variable, value), without nulls and NaN."""
    values = [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(keys, values, "variable", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
