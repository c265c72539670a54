"""Sources, parsers and streams."""

import json
import os

from pyspark.sql import functions as F

from littoral.sources import cap, iot, registry, tabledap
from littoral.streaming import pipeline, state

NOW = "2024-02-01 00:00:00"
START = 1_700_000_000_000_000


def test_tabledap(spark, tmp_path):
    assert tabledap.url("http://x", "d", ["a", "b"], "S1", "2024-01-01T00:00:00Z") == 'http://x/d.csvp?time,a,b&station="S1"&time>=2024-01-01T00:00:00Z'
    (tmp_path / "a.csv").write_text("time (UTC),water_level (m),wave_height (m)\n2024-01-01T00:00:00Z,1.5,NaN\nbad,2,2\n2024-01-01T01:00:00Z,,0.5\n")
    got = tabledap.read(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "none.csv")}).collect()
    assert sorted((r.station_id, r.variable, r.value) for r in got) == [("a", "water_level", 1.5), ("a", "wave_height", 0.5)]
    wide = spark.createDataFrame([("s", 1.0, None), ("t", float("nan"), 2.0)], "k string, a double, b double")
    assert sorted(map(tuple, tabledap.unpivot(wide, ["k"]).collect())) == [("s", "a", 1.0), ("t", "b", 2.0)]


def test_cap(spark):
    docs = spark.createDataFrame(list(enumerate(cap.SAMPLES)), "id long, xml string")
    rows = {r.identifier: r for r in cap.parse(docs).collect()}
    assert set(rows) == {"A-1", "A-2"}
    assert rows["A-1"].hazard_type == "storm_surge" and len(rows["A-1"].polygon) == 4 and rows["A-1"].circle is None
    assert rows["A-2"].hazard_type == "high_waves" and rows["A-2"].circle.radius_km == 15.5
    assert [(r.identifier) for r in cap.superseded(docs).collect()] == ["A-1"]
    a = rows["A-1"]
    polygon = F.array(F.array(*(F.struct(F.lit(p.lat).alias("lat"), F.lit(p.lon).alias("lon")) for p in a.polygon)))
    xml = spark.range(1).select(F.lit(7).cast("long").alias("id"), cap.to_xml(F.lit("B<1"), F.lit("s"), F.lit("2024-01-01T00:00:00Z"), F.lit("tsunami & waves"), F.lit("Likely"), F.lit("h"), polygon).alias("xml"))
    back = cap.parse(xml).first()
    assert (back.identifier, back.event, back.hazard_type, len(back.polygon)) == ("B<1", "tsunami & waves", "tsunami", 4)


def test_iot(spark):
    good = {"name": "n", "lat": 13.05, "lon": 80.28, "readings": [{"variable": "water_level", "value": 1.5, "time": "2030-01-01T00:00:00Z"}, {"variable": "wind", "value": "2"}]}
    bad = [("sensors/iot/a/b/telemetry", good), ("sensors/iot//telemetry", good), ("sensors/iot/a/telemetry", {**good, "lat": 99}), ("sensors/iot/a/telemetry", {**good, "readings": [{"variable": "x", "value": "?"}]}), ("sensors/iot/a/telemetry", {})]
    rows = [("sensors/iot/a/telemetry", json.dumps(good)), *((t, json.dumps(p)) for t, p in bad), ("sensors/iot/a/telemetry", "no json")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, topic string, payload string")
    readings, rejected = iot.parse(df, F.lit(NOW).cast("timestamp"))
    got = readings.collect()
    assert sorted((r.station_id, r.variable, r.value) for r in got) == [("iot-a", "water_level", 1.5), ("iot-a", "wind", 2.0)]
    assert {r.time.isoformat() for r in got} == {"2024-02-01T00:05:00", "2024-02-01T00:00:00"}
    assert {r.id: r.error for r in rejected.collect()} == {1: "topic", 2: "topic", 3: "place", 4: "reading", 5: "payload", 6: "payload"}
    assert [(r.station_id, r.variables) for r in iot.stations(readings).collect()] == [("iot-a", ["water_level", "wind"])]


def test_registry(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("key: tide\norder: 2\ninstrument_variables: [water_level]\n")
    (tmp_path / "a.yaml").write_text("key: storm\norder: 1\nalert_label_en: Big storm\n")
    got = registry.hazards_from_yaml(spark, str(tmp_path)).collect()
    assert [(r.hazard_type, r.label, r.variables) for r in got] == [("storm", "Big storm", []), ("tide", "Tide", ["water_level"])]
    assert registry.hazards(spark).count() == 9 and registry.landmarks(spark).count() == 5
    (tmp_path / "s.json").write_text(json.dumps([{"id": "a", "enabled": True}, {"id": "b", "enabled": False}]))
    assert [r.id for r in registry.enabled_stations(spark, str(tmp_path / "s.json")).collect()] == ["a"]


def stream(spark, folder, batches, schema):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of age
    return pipeline.read_json(spark, str(folder), schema, files_per_trigger=1)


def test_ingest_stream(spark, tmp_path):
    r = {"source": "app", "external_id": "u1", "lat": 13.05, "lon": 80.28, "observed_at": "2024-01-31T23:00:00"}
    batches = [
        [{**r, "client_key": "k1", "text": "flood here, help"}, {**r, "client_key": "k2", "text": "?", "hazard_type": "tsunami", "observed_at": "2023-01-01T00:00:00"}],
        [{**r, "client_key": "k1", "text": "flood here, help"}, {**r, "client_key": "k3", "lat": 99.0}],
    ]
    now = F.lit(NOW).cast("timestamp")
    s = stream(spark, tmp_path / "in", batches, pipeline.REPORT)
    pipeline.run(pipeline.ingest(s, now), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((x.hazard_type, x.urgency, x.created_at.isoformat()) for x in got) == [("coastal_flooding", "high", "2024-01-31T23:00:00"), ("tsunami", "medium", "2024-01-31T00:00:00")]
    pipeline.run(pipeline.ingest(s, now), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_reports_without_a_key_all_pass(spark, tmp_path):
    r = {"source": "app", "external_id": "u1", "lat": 13.05, "lon": 80.28, "observed_at": "2024-01-31T23:00:00"}
    batches = [[{**r, "text": "one"}, {**r, "text": "two"}, {**r, "client_key": "k", "text": "three"}], [{**r, "client_key": "k", "text": "three"}, {**r, "text": "four"}]]
    s = stream(spark, tmp_path / "in", batches, pipeline.REPORT)
    pipeline.run(pipeline.ingest(s, F.lit(NOW).cast("timestamp")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(x.text for x in got) == ["four", "one", "three", "two"] and len({x.id for x in got}) == 4


def test_hourly_stream_equals_batch(spark, tmp_path):
    rows = [{"station_id": "a", "variable": "w", "time": f"2024-01-0{1 + i // 24}T{i % 24:02d}:{m:02d}:00", "value": float(i + m)} for i in range(30) for m in (5, 40)]
    s = stream(spark, tmp_path / "in", [rows[:20], rows[10:45], rows[45:]], pipeline.READING)
    q = pipeline.hourly(s).writeStream.format("memory").queryName("rollup").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.hour, r.avg, r.n) for r in spark.table("rollup").collect()}
    batch = spark.read.schema(pipeline.READING).json(str(tmp_path / "in")).distinct().groupBy(F.window("time", "1 hour").alias("w")).agg(F.avg("value").alias("a"), F.count("*").alias("n"))
    assert got == {(r.w.start, r.a, r.n) for r in batch.collect()}


def run_state(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_limiter_stream(spark, tmp_path):
    t = [0, 60, 120, 800, 810, 5000]
    rows = [{"reporter": "a", "id": i, "t": START + x * 1_000_000} for i, x in enumerate(t)]
    s = stream(spark, tmp_path / "in", [rows[:2], rows[2:4], rows[4:]], "reporter string, id long, t long")
    got = {r.id: (r.place, r.allowed) for r in run_state(state.limiter(s, "reporter", 2), "limits")}
    assert [got[i] for i in range(6)] == [(1, True), (2, True), (3, False), (1, True), (2, True), (1, True)]


def test_conversation_stream(spark, tmp_path):
    msg = [("location", "13,80"), ("photo", "x"), ("hazard", "tsunami"), ("text", "skip"), ("description", "skip"), ("photo", "p.jpg"), ("location", "1,2"), ("text", "cancel"), ("location", "3,4")]
    rows = [{"session": "s", "id": i, "t": START + i * 1_000_000, "kind": k, "body": b} for i, (k, b) in enumerate(msg)]
    rows.append({"session": "s", "id": 99, "t": START + 2000 * 1_000_000, "kind": "hazard", "body": "late"})
    s = stream(spark, tmp_path / "in", [rows[:3], rows[3:]], "session string, id long, t long, kind string, body string")
    got = [r.step for r in sorted(run_state(state.conversations(s), "talks"), key=lambda r: r.t)]
    assert got == ["hazard", "hazard", "description", "photo", "done", "location", "hazard", "cancelled", "hazard", "location"]


def test_alert_stream_only_rises(spark, tmp_path):
    steps = [("advisory", "auto"), ("watch", "auto"), ("advisory", "auto"), ("warning", "analyst"), ("watch", "auto"), (None, "analyst"), ("advisory", "auto")]
    rows = [{"incident": "i", "id": i, "t": i, "tier": t, "by": b} for i, (t, b) in enumerate(steps)]
    s = stream(spark, tmp_path / "in", [rows[:3], rows[3:]], "incident string, id long, t long, tier string, by string")
    got = [(r.tier, r.by) for r in run_state(state.alert_changes(s), "alerts")]
    assert got == [("advisory", "auto"), ("watch", "auto"), ("warning", "analyst"), (None, None), ("advisory", "auto")]


def test_merge_stream_equals_batch(spark, tmp_path):
    from littoral.operators.kernels import merge_incidents

    rows = [{"hazard_type": "h", "t": START + i * 1_800_000_000, "id": i, "row": i * 7 % 5, "col": i * 3 % 4, "lat": 13.0, "lon": 80.0, "v": [1.0, i % 3 / 2] if i % 4 else None} for i in range(40)]
    schema = "hazard_type string, t long, id long, row int, col int, lat double, lon double, v array<double>"
    s = stream(spark, tmp_path / "in", [rows[:15], rows[15:16], rows[16:]], schema)
    got = {r.id: r.incident for r in run_state(state.merge_incidents(s), "merged")}
    batch = merge_incidents(spark.read.schema(schema).json(str(tmp_path / "in")), ["hazard_type"])
    assert got == {r.id: r.incident for r in batch.collect()} and len(set(got.values())) > 1


def test_overload():
    assert not pipeline.overloaded(None) and pipeline.overloaded({"sources": [{"metrics": {"numRowsOutstanding": "900"}}]})
