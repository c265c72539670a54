"""Keyed state over streams of reports: limits, conversations and alert tiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fixed import TIERS
from ..operators.kernels import IncidentBook

SECOND = 1_000_000


def _timed(stream: DataFrame, late: str) -> DataFrame:
    """With event time, and a watermark that lets state go: rows later than ``late`` are dropped."""
    return stream.withColumn("_time", F.timestamp_micros("t")).withWatermark("_time", late)


def _expire(state: GroupState, last: int, seconds: int) -> None:
    state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))


def limiter(stream: DataFrame, key: str, limit: int, gap_seconds: int = 600, late: str = "1 hour") -> DataFrame:
    """key, id, t, place, allowed: the place of each row in its session, which ends once ``gap_seconds`` pass without a
    row of the key. Refused rows count too. Rows of one trigger are taken in order of t and id. State goes once the
    watermark, ``late`` behind the newest row, has passed the gap.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        place, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        places = []
        for t in rows["t"].tolist():
            place = 1 if last is None or t - last > gap_seconds * SECOND else place + 1
            last = max(t, last or t)
            places.append(place)
        state.update((place, last))
        _expire(state, last, gap_seconds)
        yield pd.DataFrame({key: k[0], "id": rows["id"].to_numpy(), "t": rows["t"].to_numpy(), "place": places, "allowed": [p <= limit for p in places]})

    kind = dict(stream.dtypes)[key]
    out = f"{key} {kind}, id long, t long, place int, allowed boolean"
    return _timed(stream.select(key, "id", "t"), late).groupBy(key).applyInPandasWithState(step, out, "place int, last long", "append", GroupStateTimeout.EventTimeTimeout)


#: What a session waits for, in order.
STEPS = ["location", "hazard", "description", "photo", "done"]


def advance(step: str, kind: str, body: str | None) -> str:
    """The next step: each takes its own kind of message; 'skip' passes a description or a photo; 'cancel' ends it."""
    if body is not None and body.strip().lower() == "cancel":
        return "cancelled"
    skips = step in ("description", "photo") and body is not None and body.strip().lower() == "skip"
    if kind == step or skips:
        return STEPS[STEPS.index(step) + 1]
    return step


def conversations(stream: DataFrame, key: str = "session", ttl_seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """key, t, step, fields: the session after each message (key, t, id, kind, body). A finished or cancelled session, or
    one silent for ``ttl_seconds``, starts anew with the next message. fields is JSON of what was gathered."""
    import json

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step, fields, last = state.get if state.exists else ("location", "{}", 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["t", "id"]).itertuples():
            if step in ("done", "cancelled") or r.t - last > ttl_seconds * SECOND:
                step, fields = "location", "{}"
            nxt = advance(step, r.kind, r.body)
            if nxt != step and nxt != "cancelled" and r.kind == step:
                fields = json.dumps({**json.loads(fields), step: r.body})
            step, last = nxt, r.t
            out.append((k[0], r.t, step, fields))
        state.update((step, fields, last))
        _expire(state, last, ttl_seconds)
        yield pd.DataFrame(out, columns=[key, "t", "step", "fields"])

    kind = dict(stream.dtypes)[key]
    return _timed(stream.select(key, "t", "id", "kind", "body"), late).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, t long, step string, fields string", "step string, fields string, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def alert_changes(stream: DataFrame) -> DataFrame:
    """incident, tier, by: changes of each incident's active alert from (incident, t, id, tier, by). Automatic tiers only
    raise it, and never touch one that an analyst issued; an analyst's tier always holds; a null tier by an analyst ends it."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tier, by = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(frames)).sort_values(["t", "id"]).itertuples():
            new = None if r.tier is None or r.tier != r.tier else r.tier
            if r.by == "analyst":
                now = (new, "analyst") if new else (None, None)
            elif new and by != "analyst" and (tier is None or TIERS.index(new) > TIERS.index(tier)):
                now = (new, "auto")
            else:
                continue
            if now != (tier, by):
                tier, by = now
                out.append((k[0], tier, by))
        state.update((tier, by))
        yield pd.DataFrame(out, columns=["incident", "tier", "by"])

    return stream.select("incident", "t", "id", "tier", "by").groupBy("incident").applyInPandasWithState(
        run, "incident string, tier string, by string", "tier string, by string", "append", GroupStateTimeout.NoTimeout
    )


def first_seen(stream: DataFrame, key: str, time: str, late: str = "24 hours") -> DataFrame:
    """One row for each key within the watermark: replays of a client's message are dropped. Rows without a key can't be
    replays of anything and all pass."""
    timed = stream.withWatermark(time, late)
    once = timed.filter(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return once.unionByName(timed.filter(F.col(key).isNull()))


def merge_incidents(stream: DataFrame, window_hours: float = 6.0) -> DataFrame:
    """hazard_type, id, incident, n: each report's incident as it comes (hazard_type, t, id, row, col, lat, lon, v), by
    the same rule as in batch. The state of a hazard is its incidents of the last hours."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = IncidentBook(window_hours)
        if state.exists:
            book.load(state.get[0])
        rows = pd.concat(list(frames)).sort_values(["t", "id"]).to_dict("records")
        out = []
        for r in rows:
            home = book.assign(r)
            out.append((k[0], r["id"], home["id"], home["n"]))
        state.update((book.dump(),))
        yield pd.DataFrame(out, columns=["hazard_type", "id", "incident", "n"])

    wanted = stream.select("hazard_type", "t", "id", "row", "col", "lat", "lon", "v")
    return wanted.groupBy("hazard_type").applyInPandasWithState(
        run, "hazard_type string, id long, incident long, n long", "book string", "append", GroupStateTimeout.NoTimeout
    )
