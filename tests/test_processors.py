"""Stations, anomalies and sessions as streams with keyed state and timers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from littoral.streaming import pipeline, processors

START = 1_700_000_000_000_000
HOUR = 3_600_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def stream(spark, folder, batches, schema):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return pipeline.read_json(spark, str(folder), schema, files_per_trigger=1)


def collect(df, name, checkpoint):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def message(node, id, variable, place=None, name=None):
    lat, lon = place or (None, None)
    return {"station_id": f"iot-{node}", "id": id, "name": name, "lat": lat, "lon": lon, "readings": [{"variable": variable, "time": "2024-01-01T00:00:00Z", "value": 1.0}], "error": None, "topic": "t", "payload": "p"}


SCHEMA = "station_id string, id long, name string, lat double, lon double, readings array<struct<variable:string,time:timestamp,value:double>>, error string, topic string, payload string"


def test_stations_keep_their_place_and_gather_variables(spark, tmp_path):
    batches = [
        [message("a", 1, "wind", (13.0, 80.0)), message("b", 2, "wind")],
        [message("a", 3, "water_level"), message("b", 4, "wind"), message("c", 5, "wind", (1.0, 2.0), "Pier")],
        [message("b", 6, "wind", (12.0, 80.0)), message("a", 7, "wind", (13.5, 80.5), "Jetty"), message("b", 8, "rain"), message("c", 9, "wind")],
    ]
    got = {r["id"]: r for r in collect(processors.stations(stream(spark, tmp_path / "in", batches, SCHEMA)), "stations", tmp_path / "cp")}
    assert {i: r["outcome"] for i, r in got.items()} == {1: "registered", 2: "unplaced", 3: "updated", 4: "unplaced", 5: "registered", 6: "registered", 7: "updated", 8: "updated", 9: "updated"}
    assert got[3]["variables"] == ["water_level", "wind"] and (got[3]["lat"], got[3]["lon"], got[3]["name"]) == (13.0, 80.0, "IoT node a")
    assert (got[7]["lat"], got[7]["name"]) == (13.5, "Jetty") and got[8]["variables"] == ["rain", "wind"] and got[9]["name"] == "Pier"
    assert got[2]["readings"] == [] and len(got[3]["readings"]) == 1


def test_a_new_checkpoint_starts_from_known_stations(spark, tmp_path):
    known = spark.createDataFrame([("iot-a", "Jetty", 13.0, 80.0, ["wind"])], processors.KNOWN)
    s = stream(spark, tmp_path / "in", [[message("a", 1, "rain"), message("b", 2, "rain")]], SCHEMA)
    got = {r["id"]: r for r in collect(processors.stations(s, known), "restarted", tmp_path / "cp")}
    assert got[1]["outcome"] == "updated" and got[1]["variables"] == ["rain", "wind"] and got[1]["lat"] == 13.0 and got[2]["outcome"] == "unplaced"


def test_silence_alone_expires_an_anomaly(spark, tmp_path):
    score = lambda station, hours, z: {"station_id": station, "variable": "w", "t": START + int(hours * HOUR), "z": z}
    batches = [
        [score("a", 0, 4.0), score("b", 0, 0.1), score("c", 0, -5.0)],
        [score("a", 1, 3.5), score("c", 1, 1.0), score("d", 1, 9.0)],
        [score("b", 6.5, 0.2)],
        [score("b", 8, 0.3), score("d", 6.9, 9.0)],
        [score("b", 9, 0.3)],
    ]
    s = stream(spark, tmp_path / "in", batches, "station_id string, variable string, t long, z double")
    got = sorted((r["station_id"], round((r["t"] - START) / HOUR, 1), r["state"]) for r in collect(processors.anomalies(s), "anomalies", tmp_path / "cp"))
    assert got == [("a", 0.0, "opened"), ("a", 1.0, "refreshed"), ("a", 7.0, "expired"), ("c", 0.0, "opened"), ("c", 1.0, "resolved"), ("d", 1.0, "opened"), ("d", 6.9, "refreshed")]


def test_a_gap_within_one_batch_expires_too(spark, tmp_path):
    rows = [{"station_id": "a", "variable": "w", "t": START + h * HOUR, "z": 5.0} for h in (0, 3, 20)]
    s = stream(spark, tmp_path / "in", [rows], "station_id string, variable string, t long, z double")
    got = [r["state"] for r in sorted(collect(processors.anomalies(s), "gaps", tmp_path / "cp"), key=lambda r: r["t"])]
    assert got == ["opened", "refreshed", "expired", "opened"]


def test_sessions_end_after_fifteen_minutes(spark, tmp_path):
    msg = lambda s, seconds, kind, body, id=0: {"session": s, "t": START + seconds * 1_000_000, "id": id, "kind": kind, "body": body}
    batches = [
        [msg("x", 0, "location", "13,80"), msg("y", 0, "location", "1,2"), msg("y", 1, "text", "cancel")],
        [msg("z", 1100, "location", "5,6")],
        [msg("z", 1200, "hazard", "tsunami"), msg("x", 1200, "location", "7,8")],
        [msg("z", 1300, "text", " Skip "), msg("z", 1301, "photo", "p.jpg")],
        [msg("w", 4000, "location", "0,0")],
    ]
    s = stream(spark, tmp_path / "in", batches, "session string, t long, id long, kind string, body string")
    got = collect(processors.sessions(s), "sessions", tmp_path / "cp")
    by = {k: [(round((r["t"] - START) / 1e6), r["step"]) for r in sorted(got, key=lambda r: r["t"]) if r["session"] == k] for k in "xyz"}
    assert by["x"] == [(0, "hazard"), (900, "expired"), (1200, "hazard"), (2100, "expired")]
    assert by["y"] == [(0, "hazard"), (1, "cancelled")] and [s for _, s in by["z"]] == ["hazard", "description", "photo", "done"]
    assert json.loads(next(r["fields"] for r in got if r["session"] == "z" and r["step"] == "done")) == {"location": "5,6", "hazard": "tsunami", "photo": "p.jpg"}


def telemetry(node, id, place, variable, value):
    body = {"readings": [{"variable": variable, "value": value, "time": "2024-01-01T00:00:00Z"}]} | ({"lat": place, "lon": 80.0} if place else {})
    return {"id": id, "topic": f"sensors/iot/{node}/telemetry", "payload": json.dumps(body)}


def test_telemetry_into_tables(spark, tmp_path):
    now = F.lit("2024-02-01").cast("timestamp")
    batches = [
        [telemetry("a", 1, 13.0, "wind", 1), telemetry("a", 2, 13.0, "wind", 1), {"id": 3, "topic": "sensors/iot/a/telemetry", "payload": "no json"}, {"id": 4, "topic": "else", "payload": "{}"}],
        [telemetry("a", 5, None, "water_level", 2), telemetry("b", 6, None, "wind", 3)],
    ]
    raw = "id long, topic string, payload string"
    pipeline.telemetry(stream(spark, tmp_path / "in", batches, raw), str(tmp_path / "out"), str(tmp_path / "cp"), now)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}").collect()
    assert sorted((r.station_id, r.variable, r.value) for r in read("readings")) == [("iot-a", "water_level", 2.0), ("iot-a", "wind", 1.0)]
    assert sorted((r.id, r.error) for r in read("rejected")) == [(3, "payload"), (4, "topic"), (6, "unplaced")]
    assert [(r.station_id, r.batch) for r in read("registered")] == [("iot-a", 0)]
    known = pipeline.known_stations(spark, str(tmp_path / "out"))
    assert [(r.station_id, r.lat, r.variables) for r in known.collect()] == [("iot-a", 13.0, ["water_level", "wind"])]
    later = stream(spark, tmp_path / "in2", [[telemetry("a", 7, None, "rain", 5)]], raw)
    pipeline.telemetry(later, str(tmp_path / "out2"), str(tmp_path / "cp2"), now, known)
    (station,) = pipeline.known_stations(spark, str(tmp_path / "out2")).collect()
    assert (station.lat, station.variables) == (13.0, ["rain", "water_level", "wind"]) and spark.read.parquet(f"{tmp_path}/out2/registered").count() == 0
