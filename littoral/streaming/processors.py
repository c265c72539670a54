"""Keyed state with timers: sensor stations, anomalies that end in silence, and chat sessions.

State lives in the RocksDB state store, so it is bounded by disk and not by an executor's memory; the session must set
spark.sql.streaming.stateStore.providerClass to that store (``littoral.session`` does). Timers fire by the watermark
alone: a key that stays silent ends as soon as others' rows move event time past its timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import advance

_READING = "array<struct<variable:string,time:timestamp,value:double>>"
STATION = f"station_id string, id long, outcome string, name string, lat double, lon double, variables array<string>, readings {_READING}, topic string, payload string"
KNOWN = "station_id string, name string, lat double, lon double, variables array<string>"


class Stations(StatefulProcessor):
    """A station's name and place as values, its variables as a map. The first message must bring a place, else it is
    rejected and leaves no trace; later ones may omit name and place. Messages with an error are passed on as rejected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.station = handle.getValueState("station", "name string, lat double, lon double")
        self.variables = handle.getMapState("variables", "variable string", "id long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.station.update((initialState["name"], initialState["lat"], initialState["lon"]))
        for variable in initialState["variables"] or ():
            self.variables.updateValue((variable,), (0,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r["id"]):
            known = self.station.get() if self.station.exists() else None
            placed = r["lat"] is not None and r["lon"] is not None
            error = r["error"] or ("unplaced" if known is None and not placed else None)
            if error:
                yield Row(station_id=key[0], id=r["id"], outcome=error, name=None, lat=None, lon=None, variables=[], readings=[], topic=r["topic"], payload=r["payload"])
                continue
            name = r["name"] or (known[0] if known else f"IoT node {key[0].removeprefix('iot-')}")
            lat, lon = (r["lat"], r["lon"]) if placed else (known[1], known[2])
            self.station.update((name, lat, lon))
            for x in r["readings"]:
                if not self.variables.containsKey((x["variable"],)):
                    self.variables.updateValue((x["variable"],), (r["id"],))
            variables = sorted(v[0] for v in self.variables.keys())
            yield Row(station_id=key[0], id=r["id"], outcome="updated" if known else "registered", name=name, lat=lat, lon=lon, variables=variables, readings=r["readings"], topic=None, payload=None)

    def close(self) -> None:
        pass


def stations(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What each telemetry message does: STATION, from messages as ``sources.iot.messages`` gives them, those of a station
    in order of id. outcome is registered, updated, or why the message was rejected. ``known`` (KNOWN) are stations from
    before: a new checkpoint starts from them."""
    start = None if known is None else known.select("station_id", "name", "lat", "lon", "variables").groupBy("station_id")
    wanted = messages.select("station_id", "id", "name", "lat", "lon", F.col("readings").cast(_READING).alias("readings"), "error", "topic", "payload")
    return wanted.groupBy("station_id").transformWithState(Stations(), STATION, "append", "none", start)


def _ms(t: int) -> int:
    return t // 1000


class Anomalies(StatefulProcessor):
    """Whether a series has an open anomaly, and a timer at which silence ends it."""

    def __init__(self, threshold: float, stale_seconds: int) -> None:
        self.threshold, self.stale = threshold, stale_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "since long, seen long, timer long")

    def _end(self) -> None:
        self.handle.deleteTimer(self.open.get()[2])
        self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = {"station_id": key[0], "variable": key[1]}
        for r in sorted(rows, key=lambda r: r["t"]):
            now = self.open.get() if self.open.exists() else None
            if now and _ms(r["t"]) >= now[2]:  # silent for longer than the watermark could tell
                self._end()
                yield Row(**at, t=now[2] * 1000, z=None, state="expired")
                now = None
            if r["z"] is not None and abs(r["z"]) >= self.threshold:
                timer = max(_ms(r["t"]) + self.stale * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
                if now:
                    self.handle.deleteTimer(now[2])
                self.handle.registerTimer(timer)
                self.open.update((now[0] if now else r["t"], r["t"], timer))
                yield Row(**at, t=r["t"], z=r["z"], state="refreshed" if now else "opened")
            elif now:
                self._end()
                yield Row(**at, t=r["t"], z=r["z"], state="resolved")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            self.open.clear()
            yield Row(station_id=key[0], variable=key[1], t=expiredTimerInfo.getExpiryTimeInMs() * 1000, z=None, state="expired")

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("_time", F.timestamp_micros("t")).withWatermark("_time", late)


def anomalies(scores: DataFrame, threshold: float = 3.0, stale_seconds: int = 6 * 3600, late: str = "1 minute") -> DataFrame:
    """station_id, variable, t, z, state of each series' anomaly from (station_id, variable, t, z): it is opened at
    |z| >= threshold, refreshed while that lasts, resolved by a score below, and has expired once the series is silent
    for ``stale_seconds``. No row of the series is needed for that."""
    kept = _timed(scores.select("station_id", "variable", "t", "z"), late)
    out = "station_id string, variable string, t long, z double, state string"
    return kept.groupBy("station_id", "variable").transformWithState(Anomalies(threshold, stale_seconds), out, "append", "eventtime")


class Sessions(StatefulProcessor):
    """A chat session's step and fields, and a timer that ends it."""

    def __init__(self, key: str, seconds: int) -> None:
        self.key, self.seconds = key, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "step string, fields string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
            step, fields, timer = self.session.get() if self.session.exists() else ("location", "{}", None)
            if timer is not None:
                self.handle.deleteTimer(timer)
                if _ms(r["t"]) >= timer:
                    yield Row(**{self.key: key[0]}, t=timer * 1000, step="expired", fields=fields)
                    step, fields = "location", "{}"
            after = advance(step, r["kind"], r["body"])
            if after not in (step, "cancelled") and r["kind"] == step and (r["body"] or "").strip().lower() != "skip":
                fields = json.dumps({**json.loads(fields), step: r["body"]})
            if after in ("done", "cancelled"):
                self.session.clear()
            else:
                timer = max(_ms(r["t"]) + self.seconds * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
                self.handle.registerTimer(timer)
                self.session.update((after, fields, timer))
            yield Row(**{self.key: key[0]}, t=r["t"], step=after, fields=fields)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.session.exists():
            fields = self.session.get()[1]
            self.session.clear()
            yield Row(**{self.key: key[0]}, t=expiredTimerInfo.getExpiryTimeInMs() * 1000, step="expired", fields=fields)

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, key: str = "session", ttl_seconds: int = 900, late: str = "1 minute") -> DataFrame:
    """key, t, step, fields of each session after each message (key, t, id, kind, body), and a row with step ``expired``
    for one that was left unfinished for ``ttl_seconds``, silence alone being enough. Finished and cancelled sessions
    leave no state."""
    kind = stream.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("t", T.LongType()), T.StructField("step", T.StringType()), T.StructField("fields", T.StringType())])
    kept = _timed(stream.select(key, "t", "id", "kind", "body"), late)
    return kept.groupBy(key).transformWithState(Sessions(key, ttl_seconds), out, "append", "eventtime")
