"""Operators on inputs whose results are known."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from littoral.functions import geo, media, scoring, text
from littoral.functions.fixed import GENESIS
from littoral.operators import alerts, audit, kernels, ml, privacy, recovery, regions, reports, series, spatial

HOUR = series.HOUR


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scoring_curves(spark):
    n = lambda k, h=False: scoring.coherence(F.lit(k), F.lit(h))
    got = one(spark, n(0).alias("a"), n(1).alias("b"), n(2).alias("c"), n(4).alias("d"), n(10).alias("e"), n(1, True).alias("f"))
    assert [round(x, 9) for x in got] == [0, 0.4, 0.6, 1, 1, 0.2]
    z = lambda x: scoring.instrument(F.lit(x).cast("double"))
    assert list(one(spark, z(1.0).alias("a"), z(2.5).alias("b"), z(5.0).alias("c"), z(-6.0).alias("d"), z(None).alias("e"))) == [0, 0, 1, 1, 0]
    m = lambda has, reused=False, km=None, h=None: scoring.media(F.lit(has), F.lit(reused), F.lit(km).cast("double"), F.lit(h).cast("double"))
    got = one(spark, *(c.alias(f"c{i}") for i, c in enumerate([m(False), m(True, True), m(True, False, 9.0), m(True, False, 1.0, 9.0), m(True), m(True, False, 1.0, 1.0)])))
    assert list(got) == [0.5, 0.0, 0.2, 0.4, 0.6, 1.0]
    assert one(spark, scoring.account_device(F.lit(168.0), F.lit(3)).alias("x")).x == 0.7
    assert one(spark, scoring.combine(trust=F.lit(1.0), coherence=F.lit(1.0), instrument=F.lit(1.0), media=F.lit(1.0), satellite=F.lit(1.0), account_device=F.lit(1.0), official=F.lit(1.0)).alias("x")).x == 1.0
    gate = scoring.corroborated(F.lit(0.9), F.lit(0.0), F.lit(0.0))
    assert one(spark, gate.alias("x")).x is False
    tier = lambda s, n, z: scoring.eligible_tier(F.lit(s), F.lit(n), F.lit(z))
    assert list(one(spark, tier("new", 9, 1.0).alias("a"), tier("verified", 2, 1.0).alias("b"), tier("verified", 3, 1.0).alias("c"))) == [None, "advisory", "watch"]


def test_text_rules(spark):
    rows = spark.createDataFrame([(1, "The FLOOD and a big wave, flood"), (2, "help! I heard of a minor oil slick"), (3, None), (4, "nothing"), (5, "yesterday slowly")], "id int, text string")
    hazard, hits = text.classify(F.col("text"))
    got = {r.id: (r.h, r.n, r.u, r.s) for r in rows.select("id", hazard.alias("h"), hits.alias("n"), text.urgency(F.col("text")).alias("u"), text.hearsay(F.col("text")).alias("s")).collect()}
    assert got[1][:2] == ("coastal_flooding", 1) and got[2] == ("oil_spill", 2, "high", True) and got[3] == (None, 0, "medium", False) and got[4][0] is None and got[5][2] == "low"
    assert one(spark, text.event_to_hazard(F.lit("Storm Surge Warning")).alias("x")).x == "storm_surge"
    assert one(spark, text.normal_phone(F.lit("+91 (98400)-12345")).alias("x"), text.normal_lang(F.lit("ta-IN")).alias("y"), text.normal_lang(F.lit("te")).alias("z"))[:] == ("9840012345", "ta", "en")


def test_distances_and_polygons(spark):
    d = lambda a, b, c, e: geo.haversine_km(F.lit(a), F.lit(b), F.lit(c), F.lit(e))
    got = one(spark, d(13.0827, 80.2707, 12.9716, 77.5946).alias("a"), d(1.0, 2.0, 1.0, 2.0).alias("b"))
    assert 280 < got.a < 300 and got.b == 0
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))))
    inside = lambda a, b: geo.in_ring(F.lit(a), F.lit(b), ring)
    assert list(one(spark, inside(1.0, 1.0).alias("a"), inside(3.0, 1.0).alias("b"), inside(1.0, 2.5).alias("c"))) == [True, False, False]


def test_trailing_baseline(spark):
    rng = np.random.default_rng(7)
    rows = [("s", i * HOUR * 3, float(rng.normal(1.0, 0.1))) for i in range(900)] + [("f", i * HOUR, 1.0) for i in range(60)] + [("x", i, float(i)) for i in range(29)]
    df = spark.createDataFrame(rows, "k string, t long, value double")
    got = {(r.k, r.t): r for r in series.trailing_stats(df, ["k"]).collect()}
    assert len(got) == len(rows)
    pdf = pd.DataFrame(rows, columns=["k", "t", "value"])
    for r in pdf[pdf.k == "s"].iloc[::37].itertuples():
        base = pdf[(pdf.k == "s") & (pdf.t >= r.t - 7 * series.DAY) & (pdf.t < r.t)].value
        g = got["s", r.t]
        assert g.n == len(base)
        if len(base):
            assert math.isclose(g.mean, base.mean(), rel_tol=1e-9) and math.isclose(g.std, base.std(ddof=0), rel_tol=1e-6, abs_tol=1e-7)
    spike = spark.createDataFrame(rows[:200] + [("s", 200 * HOUR * 3, 2.5)], "k string, t long, value double")
    assert [r.t for r in series.anomalies(spike, ["k"], z=8.0).collect()] == [200 * HOUR * 3]
    assert series.anomalies(df.filter("k <> 's'"), ["k"]).count() == 0


def test_trailing_baseline_far_from_zero(spark):
    """Pressure in pascals: a flat series has no spread, a small spread keeps its digits."""
    rng = np.random.default_rng(2)
    rows = [("flat", i * HOUR, 101325.3) for i in range(200)] + [("fine", i * HOUR, 101325.3 + float(rng.normal(0, 0.01))) for i in range(200)] + [("fine", 200 * HOUR, 101325.4)]
    df = spark.createDataFrame(rows, "k string, t long, value double")
    got = {(r.k, r.t): r for r in series.trailing_stats(df, ["k"]).collect()}
    assert max(r.std for (k, _), r in got.items() if k == "flat" and r.n) < 1e-9
    base = np.array([v for k, t, v in rows if k == "fine" and 32 * HOUR <= t < 200 * HOUR])
    last = got["fine", 200 * HOUR]
    assert last.n == len(base) and math.isclose(last.std, base.std(), rel_tol=1e-6) and math.isclose(last.mean, base.mean(), rel_tol=1e-12)
    assert {r.k for r in series.anomalies(df, ["k"], z=6.0).collect()} == {"fine"}


def test_backtest_uses_only_the_past(spark):
    t = np.arange(400)
    rows = [("s", int(h) * HOUR, float(1 + 0.01 * h + 0.3 * np.sin(2 * np.pi * h / 12.42)) if h <= 300 else 99.0) for h in t]
    df = spark.createDataFrame(rows, "k string, t long, value double")
    for r in series.harmonic_forecast(df, ["k"], as_of=300 * HOUR).collect():
        h = r.t / HOUR
        assert 300 < h <= 306 and abs(r.value - (1 + 0.01 * h + 0.3 * np.sin(2 * np.pi * h / 12.42))) < 0.05


def test_harmonic_forecast(spark):
    f = lambda h: 1 + 0.01 * h + 0.3 * math.sin(2 * math.pi * h / 12.42)
    df = spark.createDataFrame([("a", h * HOUR, f(h)) for h in range(240)] + [("b", h * HOUR, 1.0) for h in range(5)], "k string, t long, value double")
    got = series.harmonic_forecast(df, ["k"], history=30 * series.DAY).collect()
    assert {r.k for r in got} == {"a"} and len(got) == 12
    for r in got:
        if r.t <= 242 * HOUR:
            assert abs(r.value - f(r.t / HOUR)) < 0.05
    two = series.harmonic_forecast(df, ["k"], horizon_hours=2, step_minutes=30)
    assert two.count() == 4 and two.agg(F.min("t")).first()[0] > 239 * HOUR


def test_front(spark):
    north = [("n", i * HOUR // 2, 13.0 + i * 1.0 / 111.32, 80.28) for i in range(6)]
    df = spark.createDataFrame(north + [("few", i, 13.0, 80.0) for i in range(3)] + [("still", i * HOUR, 13.0, 80.0) for i in range(6)] + [("now", 5, 13.0 + i, 80.0) for i in range(6)], "k string, t long, lat double, lon double")
    got = {r.k: r for r in series.front(df, ["k"]).collect()}
    assert set(got) == {"n"} and abs(got["n"].speed_kmh - 2) < 0.01 and min(got["n"].bearing_deg, 360 - got["n"].bearing_deg) < 0.1


def test_limits(spark):
    t = [0, 60, 120, 800, 810, 5000]
    df = spark.createDataFrame([("a", i, x * 1_000_000) for i, x in enumerate(t)], "key string, id long, t long")
    got = {r.id: r.place for r in series.gap_sessions(df, ["key"], 600 * 1_000_000, ["t", "id"]).collect()}
    assert [got[i] for i in range(6)] == [1, 2, 3, 1, 2, 1]
    got = {r.id: (r.place, r.allowed) for r in series.anchored_windows(df, "key", 700 * 1_000_000, 2).collect()}
    assert [got[i] for i in range(6)] == [(1, True), (2, True), (3, False), (1, True), (2, True), (1, True)]


def test_nearest_far_places(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 40.0), (3, 0.0, 0.0)], "id int, lat double, lon double")
    right = spark.createDataFrame([("a", 0.3, 0.0), ("b", 0.0, 0.29), ("c", 60.0, 60.0)], "name string, rlat double, rlon double")
    got = {r.id: r.name for r in spatial.nearest(left, right, "id", "name").collect()}
    assert got == {1: "b", 2: "c", 3: "b"}


def test_radius_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([10, 70], [11, 71], (200, 2)))], "id int, lat double, lon double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([10, 70], [11, 71], (100, 2)))], "rid int, rlat double, rlon double")
    got = {(r.id, r.rid) for r in spatial.within_km(a, b, 20.0).collect()}
    every = a.crossJoin(b).filter(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")) <= 20)
    assert got == {(r.id, r.rid) for r in every.collect()}


def test_near_hashes_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    hashes = [base[i % 20] ^ sum(1 << int(b) for b in rng.integers(0, 64, i % 9)) for i in range(150)]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)], "id long, hi long, lo long")
    got = sorted(r.id for r in spatial.near_hashes(df).collect())
    assert got == [i for i, h in enumerate(hashes) if any((h ^ g).bit_count() <= 6 for g in hashes[:i])]


def test_few_hashes_share_a_key(spark):
    rng = np.random.default_rng(3)
    hashes = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 1 << 32, (2000, 2))], "hi long, lo long")
    keys = hashes.select("hi", "lo", F.explode(spatial.band_keys(6, 3)).alias("key"))
    pairs = keys.join(keys.withColumnsRenamed({"hi": "hi2", "lo": "lo2"}), "key").filter("hi < hi2").count()
    assert keys.count() == 84 * 2000 and pairs < 2000 * 2000 / 2 / 5000


def test_names(spark):
    people = [(1, "Kavya Raman", 0), (2, "Kavia  Raman", 1), (3, "Suresh Pillai", 1), (4, None, 1), (5, "", 0), (6, "kavya raman ", 1), (7, "a.b*c", 0), (8, "a.b*d", 1)]
    df = spark.createDataFrame(people, "id long, name string, kind int")
    got = {r.id: (r.candidates, r.best) for r in recovery.fuzzy_pairs(df, "name", "kind", "id", 0.72).collect()}
    score = lambda a, b: SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio()
    want = {}
    for i, a, k in people:
        s = [score(a, b) for _, b, o in people if a and b and o != k]
        s = [x for x in s if x >= 0.72]
        if s:
            want[i] = (len(s), round(max(s), 4))
    assert got == want


def test_ranked_matches(spark):
    rng = random.Random(4)
    names = ["Kavya Raman", "Kavia Raman", "kavya  ramon", "Suresh Pillai", "S. Pillay", "Anbu", "Anbu K", "Lakshmi Narayanan", "Laxmi Narayan", None, ""]
    people = [(i, rng.choice(names), i % 2, *((13 + rng.random() / 10, 80 + rng.random() / 10) if rng.random() < 0.8 else (None, None))) for i in range(150)]
    df = spark.createDataFrame(people, "id long, name string, kind int, lat double, lon double")
    score = lambda a, b: SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio()
    want = set()
    for i, a, k, la, lo in people:
        for j, b, o, lb, lp in people:
            if a and b and k != o and score(a, b) >= 0.72:
                km = None
                if la is not None and lb is not None:
                    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
                    km = 2 * 6371.0 * math.asin(math.sqrt(h))
                    if km > 5:
                        continue
                want.add((i, j, round(score(a, b), 3), None if km is None else round(km, 2)))
    rows = recovery.ranked_matches(df, 0.72, 5.0).collect()
    assert {(r.id, r.candidate, r.name_score, r.distance_km) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert r.rank == 1 + sum(x.id == r.id and (-x.name_score, x.candidate) < (-r.name_score, r.candidate) for x in rows)


def test_federated_fits(spark):
    """Newton's fits are the penalised likelihood's maximum; shards that lack a class are left out of its average."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    label = np.where(x[:, 0] > 0.5, 1, np.where(x[:, 1] > 0.5, 2, 3))
    rows = [(i, x[i].tolist(), int(label[i]), i % 3) for i in range(300) if not (i % 3 == 2 and label[i] == 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, shard int").repartition(5)
    fits = ml.binary_fits(df, [1, 2, 3], 4)
    assert set(fits) == {(s, c) for s in range(3) for c in (1, 2, 3)} - {(2, 1)}
    for (s, c), w in fits.items():
        own = np.array([[*v, 1.0] for _, v, _, k in rows if k == s])
        y = np.array([lab == c for _, _, lab, k in rows if k == s])
        gradient = own.T @ (1 / (1 + np.exp(-own @ w)) - y) + np.append(w[:4], 0)
        assert np.abs(gradient).max() < 1e-4
    sizes = {s: sum(k == s for *_, k in rows) for s in range(3)}
    assert np.allclose(ml.federated_average(fits, sizes, [1])[1], np.average([fits[0, 1], fits[1, 1]], axis=0, weights=[sizes[0], sizes[1]]))
    out = ml.federated_accuracy(df.drop("shard"), "vec_id", 3).collect()
    assert len(out) == 3 and all(r.f1 > 0.6 and r.central_f1 > 0.6 for r in out)
    assert all(r.f1 > 0.7 for r in ml.linear_probe(df, "vec_id").collect())


def test_image_stats(spark):
    rng = np.random.default_rng(6)
    noise, sea = rng.integers(0, 256, (16, 16, 3), dtype=np.uint8), np.zeros((16, 16, 3), dtype=np.uint8)
    sea[..., 2] = 200
    df = spark.createDataFrame([(1, bytearray(noise.tobytes())), (2, bytearray(sea.tobytes())), (3, None), (4, bytearray(b"xx"))], "id int, rgb binary")
    got = {r.id: r.s for r in df.select("id", media.image_stats("rgb").alias("s")).collect()}
    assert got[1].brightness == round(noise.mean() / 255, 4) and got[1].contrast == round((noise / 255).std(), 4) and got[1].edge_density > 0.2
    assert (got[2].water_fraction, got[2].brightness) == (1.0, round(200 / 255 / 3, 4)) and got[3].brightness is None and got[4].brightness is None
    flat = got[2].edge_density  # only the outermost pixels, which stay grey 23
    assert flat == round(60 * (((200 * 7471 + 32768) >> 16) / 255) / 256, 4)
    kind = df.filter("id = 2").select(scoring.damage(media.image_stats("rgb")["water_fraction"], media.image_stats("rgb")["edge_density"])[1].alias("x")).first().x
    assert kind == "destroyed"


def test_regions(spark):
    cells = [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 5, 5), ("b", 1, 1)] + [("c", 0, i) for i in range(40)]
    got = {tuple(r)[:3]: r.region for r in regions.with_region(spark.createDataFrame(cells, "k string, row int, col int"), ["k"]).collect()}
    assert got["a", 0, 0] == got["a", 2, 2] == "0:0" and got["a", 5, 5] == "5:5" and got["b", 1, 1] == "1:1"
    assert {got["c", 0, i] for i in range(40)} == {"0:0"}


def test_hulls_and_rings(spark):
    points = [("k", 13.0 + i / 10, 80.0 + j / 10) for i in range(4) for j in range(4)] + [("one", 5.0, 6.0)]
    got = {r.k: r.hull for r in kernels.hulls(spark.createDataFrame(points, "k string, lat double, lon double").repartition(3), ["k"]).collect()}
    assert all(len(h) > 8 and h[0] == h[-1] for h in got.values())
    assert min(p.lon for p in got["k"]) == 79.995 and max(p.lat for p in got["k"]) == 13.305 and max(p.lon for p in got["one"]) == 6.005
    square = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))))
    on = lambda a, b: one(spark, geo.on_ring(F.lit(a), F.lit(b), square).alias("x")).x
    assert on(0.0, 1.0) and on(2.0, 2.0) and not on(1.0, 1.0) and not on(0.0, 3.0)


def test_global_chain(spark):
    events = spark.createDataFrame([(i, f"e{i}") for i in range(50)], "id long, envelope string").repartition(4)
    chain = audit.global_chain(events, "id", "envelope")
    assert audit.verify_global(chain).first()[:3] == (50, None, 50)
    changed = chain.withColumn("envelope", F.when(F.col("id").isin(30, 40), "x").otherwise(F.col("envelope")))
    assert audit.verify_global(changed).first()[:3] == (50, 30, 30)
    assert audit.verify_global(chain.filter("id <> 20")).first()[1] == 21


def test_audit_chain_finds_changes(spark):
    events = spark.createDataFrame([("x", i, f"e{i}") for i in range(4)], "s string, id long, env string")
    log = audit.entries(events, "s", "id", "env")
    assert audit.verify(log, "s", "id", "envelope").first().bad == 0
    assert log.filter("id = 3").first().hash == audit.heads(events, "s", "id", "env").first().head
    changed = log.withColumn("envelope", F.when(F.col("id") == 2, "other").otherwise(F.col("envelope")))
    assert audit.verify(changed, "s", "id", "envelope").first()[:] == ("x", 4, 1, 2)
    swapped = log.withColumn("id", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("id")))
    assert audit.verify(swapped, "s", "id", "envelope").first().bad > 0
    assert len(GENESIS) == 64


def test_release_hides_small_groups(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 10, "g string")
    got = privacy.release(df, ["g"], 5, 1e9, "s").collect()
    assert [(r.g, r.report_count) for r in got] == [("b", 10)]


def test_flooding(spark):
    cells = spark.createDataFrame([("a", -1.0), ("b", 0.5), ("c", 1.5), ("d", 3.0), ("e", 10.0)], "cell string, elevation_m double")
    assert {r.cell for r in privacy.flooded(cells, 1.0).collect()} == {"a", "b"}
    assert {r.cell for r in privacy.flooded(cells, 2.0).collect()} == {"a", "b", "c"}


def test_density_clusters():
    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [np.array([[20.0, 20.0], [-15.0, 3.0]])])
    label = kernels.hdbscan(blobs, 5)
    assert len({*label.tolist()} - {-1}) == 3 and label[-1] == label[-2] == -1
    assert all(len(set(label[i * 30 : i * 30 + 30].tolist()) - {-1}) == 1 for i in range(3))
    assert (kernels.hdbscan(blobs[:6], 5) == -1).all()


def test_merge_and_leaders(spark):
    rows = [("h", 0, 1, 0, 0, 13.0, 80.0, [1.0, 0.0]), ("h", 1, 2, 0, 1, 13.1, 80.0, [0.9, 0.1]), ("h", 2, 3, 0, 1, 13.1, 80.0, [0.0, 1.0]), ("h", 8 * HOUR, 4, 0, 0, 13.0, 80.0, None), ("h", 8 * HOUR + 1, 5, 9, 9, 14.0, 80.0, None)]
    df = spark.createDataFrame(rows, "hazard string, t long, id long, row int, col int, lat double, lon double, v array<double>")
    got = {r.id: r.incident for r in kernels.merge_incidents(df, ["hazard"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    clusters = {r.id: r.cluster for r in kernels.leader_clusters(df, ["hazard"], least=2).collect()}
    assert clusters == {1: 1, 2: 1}


def test_incidents_cross_midnight_and_end_at_gaps(spark):
    day = 24 * HOUR
    rows = [("h", day - HOUR, 1, 0, 0, 13.0, 80.0, None), ("h", day + HOUR, 2, 0, 1, 13.2, 80.0, None), ("h", day + 7 * HOUR, 3, 0, 0, 13.1, 80.0, None), ("h", day + 13 * HOUR + 1, 4, 0, 0, 13.0, 80.0, None), ("k", day, 5, 0, 0, 13.0, 80.0, None)]
    df = spark.createDataFrame(rows, "hazard string, t long, id long, row int, col int, lat double, lon double, v array<double>")
    got = kernels.merge_incidents(df.withColumn("day", F.floor(F.col("t") / day)), ["hazard"], keep=("day",))
    assert got.columns == ["hazard", "day", "id", "incident", "n", "lat", "lon"]
    assert sorted((r.id, r.day, r.incident, r.n, r.lat) for r in got.collect()) == [(1, 0, 1, 3, 13.1), (2, 1, 1, 3, 13.1), (3, 1, 1, 3, 13.1), (4, 1, 4, 1, 13.0), (5, 1, 5, 1, 13.0)]


def test_incident_merge_query_has_no_day_border(spark):
    """Against one pass by hazard over all reports, as the stream does it."""
    from littoral.plans import catalog, views

    d = "/root/testdata/sf0.001"
    rows = kernels.with_vectors(views.reports(spark, d), views.table(spark, d, "embeddings")).orderBy("t", "id").collect()
    books, homes, days = {}, {}, {}
    for r in rows:
        homes[r.id] = books.setdefault(r.hazard_type, kernels.IncidentBook()).assign(r.asDict())
        days.setdefault(homes[r.id]["id"], set()).add(r.t // (24 * HOUR))
    want = {i: (h["id"], h["n"], round(h["lat"], 6), round(h["lon"], 6)) for i, h in homes.items()}
    got = {r.id: (r.incident, r.n, r.lat, r.lon) for r in catalog.QUERIES["incident_merge"](spark, d).collect()}
    assert got == want and any(len(x) > 1 for x in days.values())


def test_hotspot_movement(spark):
    rows = [("d", 1, 13.0, 80.0, True), ("d", 2, 14.0, 80.0, True), ("d", 1, 13.01, 80.0, False), ("d", 3, 20.0, 80.0, False)]
    df = spark.createDataFrame(rows, "day string, id long, lat double, lon double, current boolean")
    assert sorted((r.id, r.movement) for r in kernels.match_hotspots(df, ["day"]).collect()) == [(1, "persisting"), (2, "new"), (3, "cleared")]


def test_alert_texts(spark):
    m = alerts.message(F.lit("high_waves"), F.lit("watch"), F.lit(2), F.lit("Stay off the pier."))
    got = one(spark, m["en"]["standard"].alias("a"), alerts.pick(m, F.lit("xx"), F.lit("sms")).alias("b"), alerts.pick(m, F.lit("ta"), F.lit("push")).alias("c"))
    assert got.a.endswith("WATCH: High waves reported near your area (2 reports). Stay off the pier.") and got.b == "WATCH: High waves near you (2 reports)." and "அதிக அலைகள்" in got.c


def test_upsert_and_guards(spark):
    table = spark.createDataFrame([(1, "a", "open"), (2, "b", "closed")], "id int, name string, status string")
    new = spark.createDataFrame([(1, None), (3, "c")], "id int, name string")
    assert {(r.id, r.name) for r in reports.upsert(table, new, "id").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    got = {r.id: (r.status, r.applied) for r in reports.guarded(table, table.select("id"), "id", "open", "done").collect()}
    assert got == {1: ("done", True), 2: ("closed", False)}


def test_pictures_and_lines(spark):
    rng = np.random.default_rng(3)
    g = rng.random((32, 32)).ravel()
    df = spark.createDataFrame([(1, g.tolist()), (2, (g + 0.001).tolist()), (3, None), (4, [1.0])], "id int, g array<double>")
    got = {r.id: r.h for r in df.select("id", media.perceptual_hash("g").alias("h")).collect()}
    assert got[1] == got[2] and len(got[1]) == 16 and got[3] is None and got[4] is None
    line = one(spark, media.decode_polyline(F.lit("_izlhA~rlgdF_{geC~ywl@")).alias("p")).p
    assert [(round(x.lat, 5), round(x.lon, 5)) for x in line] == [(38.5, -120.2), (40.7, -120.95)]
    assert one(spark, media.degrees_of(F.array(F.lit(13.0), F.lit(30.0), F.lit(36.0)), F.lit("S")).alias("x")).x == -13.51


@pytest.mark.parametrize("n", [1, 7])
def test_nearest_rank(spark, n):
    df = spark.createDataFrame([("k", float(i)) for i in range(n)], "k string, value double")
    r = series.nearest_rank(df, ["k"], "value", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.n, r.p50, r.p95) == (n, float(int(n * 0.5)), float(int(n * 0.95)))


def test_window_pass_has_one_exchange_for_keys(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "k string, t long, value double")
    plan = series.trailing_stats(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 2
    assert Window is not None
