"""The message log as a source: offsets, replay, bad messages, lag and load shedding."""

import json

import pytest
from pyspark.sql import functions as F

from littoral.sources import iot, message_log
from littoral.streaming.load import LagListener, LoadShedding, consume


def rows(spark, first, n, topic="sensors/iot/n{}/telemetry"):
    return spark.createDataFrame([(topic.format(i % 5), json.dumps({"k": i}) if i % 10 else "broken") for i in range(first, first + n)], "topic string, payload string")


def handle(batch):
    parsed = batch.withColumn("k", F.from_json("payload", "k long")["k"])
    return parsed.filter("k is not null").select("id", "k"), parsed.filter("k is null").select("id", "topic", "payload")


def stored(spark, path, name):
    return spark.read.parquet(f"{path}/{name}").collect()


def test_offsets_and_filters(spark, tmp_path):
    path = str(tmp_path / "log")
    message_log.append(rows(spark, 0, 40), path, 3)
    message_log.append(rows(spark, 40, 15), path, 3)
    marks = message_log.high_marks(path)
    assert sum(marks.values()) == 55 and message_log.lag(path, "g") == 55
    for p in message_log.parts(path):
        ends = [(first, first + n) for first, n, _ in message_log.segments(path, p)]
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and (not ends or ends[0][0] == 0)
    reader = message_log.LogReader({"path": path, "rowsPerTask": "7", "filter": "sensors/iot/+/telemetry"})
    plan = reader.partitions({}, reader.latestOffset())
    assert max(s.end - s.start for s in plan) <= 7
    ids = [i for s in plan for b in reader.read(s) for i in b.column("id").to_pylist()]
    assert len(ids) == len(set(ids)) == 55
    assert message_log.lag(str(tmp_path / "nowhere"), "g") == 0


@pytest.mark.parametrize("wanted,topic,fits", [("a/+/c", "a/b/c", True), ("a/+/c", "a/b/d", False), ("a/#", "a/b/c", True), ("#", "x", True), ("a/+", "a/b/c", False), ("a/+/c", "a//c", True), ("a/b", "a/b", True)])
def test_topic_filters(wanted, topic, fits):
    assert message_log.matches(wanted, topic) is fits


def test_at_least_once(spark, tmp_path):
    path, out, cp = (str(tmp_path / x) for x in ("log", "out", "cp"))
    message_log.append(rows(spark, 0, 30), path, 2)
    message_log.append(rows(spark, 0, 3, "other/{}"), path, 2)
    source = message_log.subscribe(spark, path, "g", "sensors/iot/+/telemetry")
    calls = []

    def fails_late(batch):
        calls.append(batch.count())
        good, bad = handle(batch)
        return good, bad.withColumn("x", F.raise_error(F.lit("down")))

    with pytest.raises(Exception, match="down"):
        consume(source, fails_late, out, cp)
    assert calls == [30] and message_log.lag(path, "g") == 33 and len(stored(spark, out, "done")) == 27  # half done, not committed
    consume(source, handle, out, cp)
    assert sorted(r.k for r in stored(spark, out, "done")) == [i for i in range(30) if i % 10] and len(stored(spark, out, "failed")) == 3
    message_log.append(rows(spark, 30, 10), path, 2)
    assert message_log.lag(path, "g") >= 10
    consume(source, handle, out, cp)
    consume(source, handle, out, cp)
    assert sorted(r.k for r in stored(spark, out, "done")) == [i for i in range(40) if i % 10] and len(stored(spark, out, "failed")) == 4


def test_telemetry_from_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    body = json.dumps({"lat": 13.0, "lon": 80.0, "readings": [{"variable": "wind", "value": 1}]})
    message_log.append(spark.createDataFrame([("sensors/iot/a/telemetry", body), ("sensors/iot/a/telemetry", "no json")], "topic string, payload string"), path, 1)
    source = message_log.subscribe(spark, path, "bridge", "sensors/iot/+/telemetry")
    consume(source, lambda b: iot.parse(b, F.current_timestamp()), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.station_id, r.value) for r in stored(spark, tmp_path / "out", "done")] == [("iot-a", 1.0)]
    assert [r.error for r in stored(spark, tmp_path / "out", "failed")] == ["payload"]


def test_analytics_stand_back_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    ran = []
    gate = LoadShedding(most=5, watch=[(path, "g")])
    assert gate.run(lambda: ran.append(1))
    message_log.append(rows(spark, 0, 20), path, 2)
    assert not gate.run(lambda: ran.append(2)) and gate.skipped == 1
    source = message_log.subscribe(spark, path, "g")
    consume(source, handle, str(tmp_path / "out"), str(tmp_path / "cp"))
    message_log.append(rows(spark, 20, 1), path, 2)
    consume(source, handle, str(tmp_path / "out"), str(tmp_path / "cp"))  # what a batch took is committed with the next one
    assert gate.run(lambda: ran.append(3)) and ran == [1, 3]


def test_listener_reads_progress(spark, tmp_path):
    from types import SimpleNamespace as N

    listener = LagListener()
    progress = lambda end, latest, **m: N(progress=N(id="q", sources=[N(endOffset=end, latestOffset=latest, metrics=m)]))
    listener.onQueryProgress(progress('{"0": 5, "1": 7}', '{"0": 9, "1": 707}'))
    gate = LoadShedding(500, listener)
    assert listener.total() == 704 and not gate.run(lambda: None)
    listener.onQueryProgress(progress('{"0": 9, "1": 700}', '{"0": 9, "1": 707}'))
    assert listener.total() == 7 and gate.run(lambda: None)
    listener.onQueryProgress(progress("17", "19", numRowsOutstanding="600"))
    assert gate.behind() == 600
    listener.onQueryTerminated(N(id="q", exception=None))
    assert gate.behind() == 0

    path = str(tmp_path / "log")
    message_log.append(rows(spark, 0, 12), path, 2)
    live = LagListener()
    spark.streams.addListener(live)
    try:
        query = message_log.subscribe(spark, path, "h").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        query.processAllAvailable()
        assert query.lastProgress is not None and live.total() == 0
        query.stop()
    finally:
        spark.streams.removeListener(live)
