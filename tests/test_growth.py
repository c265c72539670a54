"""Steps that must not grow with the square of a group: against brute force on crowded rows, and by their plans."""

import math
import random
import re
from difflib import SequenceMatcher
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from littoral.functions.fixed import GENESIS
from littoral.operators import audit, density, kernels, planar, recovery, reports, series, spatial
from littoral.plans import catalog
from littoral.plans import views as V

MINUTE = 60_000_000


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df):
    return [line for line in plan(df).splitlines() if re.search(r"\bJoin\b", line)]


def test_coherence_is_swept(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("hk"), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 12), rng.randint(0, 300) * MINUTE + rng.choice((0, 0, 1)), rng.choice(("new", "rejected", "verified", None))) for i in range(500)]
    rows += [(500, "h", 0, 0, None, 0, "new"), (501, "h", 0, 0, 1, 10**15, "new")]
    df = spark.createDataFrame(rows, "id long, hazard_type string, row int, col int, reporter_id long, t long, status string")
    for rings in (0, 1):
        want = {}
        for i, h, r, c, who, t, _ in rows:
            others = {b[4] for b in rows if b[1] == h and abs(b[2] - r) <= rings and abs(b[3] - c) <= rings and None not in (who, b[4]) and b[4] != who and b[6] not in (None, "rejected") and abs(b[5] - t) <= 30 * MINUTE}
            want |= {i: len(others)} if others else {}
        got = reports.coherence(df, rings=rings)
        assert {r.id: r.n for r in got.collect()} == want
        assert joins(got) and all(re.search(r"\b(reporter_id|id)#\d+L? = \1#", j) for j in joins(got))  # reports of different reporters never meet


def test_nearest_in_time_meets_no_pairs(spark):
    rng = random.Random(6)
    right = [(rng.choice("ab"), rng.choice((rng.randint(0, 3000), rng.randint(0, 100) * 10)), i, float(i)) for i in range(300)]
    left = [(i, rng.choice("abc"), rng.choice((rng.randint(-100, 3200), rng.randint(0, 100) * 10))) for i in range(300)]
    a = spark.createDataFrame(left, "forecast long, k string, t long")
    b = spark.createDataFrame(right, "k string, t long, id long, v double")
    for tolerance in (1, 7, 60):
        want = {}
        for i, k, t in left:
            near = [(abs(t - u), j, v) for k2, u, j, v in right if k2 == k and abs(t - u) <= tolerance]
            want |= {i: min(near)[2]} if near else {}
        got = series.nearest_in_time(a, b, ["k"], tolerance, "v", "id")
        assert got.columns == ["forecast", "k", "t", "actual"] and {r.forecast: r.actual for r in got.collect()} == want
        assert not joins(got)


def test_propagation_hits_meet_one_row_a_cell_and_bin(spark):
    """Each join's sides: no row of a report meets rows of other reports."""
    got = catalog.QUERIES["propagation_hits"](spark, "/root/testdata/sf0.001")
    text = plan(got)
    assert len(joins(got)) == 1 and "collect_list" in text.split("Join", 1)[1] and got.filter("hits < 1 OR hits > 9").isEmpty()


def test_global_chain_sorts_in_many_tasks_and_is_read_once(spark):
    events = spark.createDataFrame([(i * 7919 % 3001, f"e{i}") for i in range(3000)], "id long, envelope string").repartition(6)
    chain = audit.global_chain(events, "id", "envelope")
    head = GENESIS
    for r in sorted(events.collect()):
        head = sha256((head + r.envelope).encode()).hexdigest()
    assert audit.verify_global(chain, 64).first()[:] == (3000, None, 3000, head)
    ids = [r.id for r in chain.orderBy("seq").collect()]
    for bad in (ids[63], ids[64], ids[127], ids[2999]):
        changed = chain.withColumn("envelope", F.when(F.col("id") == bad, "x").otherwise(F.col("envelope")))
        assert audit.verify_global(changed, 64).first()[:3] == (3000, bad, ids.index(bad))
    assert audit.verify_global(chain.filter(F.col("id") != ids[63]), 64).first()[1] == ids[64]
    assert not joins(audit.verify_global(chain)) and "Sort" not in plan(chain)  # the one writer's task doesn't sort


def test_aid_matches_take_distances_of_places(spark):
    got = catalog.QUERIES["aid_matches"](spark, "/root/testdata/sf0.001")
    top = plan(got).split("ASIN", 1)
    assert len(joins(got)) == 3 and "Join" in top[0] and "Aggregate" in top[1]  # rows are joined above the distances, places below
    a = spark.createDataFrame([(i, "x", 13 + i % 3 / 50, 80.0) for i in range(30)] + [(99, "x", None, 80.0)], "id long, c string, lat double, lon double")
    b = spark.createDataFrame([(i, "xy"[i % 2], 13 + i % 5 / 50, 80.0) for i in range(20)], "rid long, c string, rlat double, rlon double")
    pairs = lambda f: sorted((r.id, r.rid, r.distance_km) for r in f(a, b, 3.0, on=["c"]).collect())
    assert pairs(spatial.within_km_by_place) == pairs(spatial.within_km) != []


def test_incidents_are_summed_before_they_meet_their_reports(spark):
    """No task takes all reports of a long incident for its totals, and none sorts a hazard's reports to find its gaps."""
    rows = [(i, i % 40 * 3_600_000_000 // 4 + i // 40 * 40 * 3_600_000_000, i % 2, 0, 13.0 + i, 80.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t long, row int, col int, lat double, lon double").withColumn("h", F.lit("h")).withColumn("v", F.lit(None).cast("array<double>"))
    got = kernels.merge_incidents(df, ["h"])
    assert "Window" not in plan(got)
    assert {(r.id, r.incident, r.n) for r in got.collect()} == {(i, i // 40 * 40, 40) for i in range(400)}


def test_density_takes_near_places_once(spark, monkeypatch):
    """Distances are taken between near places alone, and equal points are one place, in one tile as in several."""
    rng = np.random.default_rng(3)
    taken, between = [], planar.between

    def counted(x, y, u, v):
        taken.append(len(x) * len(u))
        return between(x, y, u, v)

    monkeypatch.setattr(planar, "between", counted)
    for points in (rng.uniform(0, 10, (6000, 2)), np.concatenate([c + rng.normal(0, 0.05, (300, 2)) for c in rng.uniform(-20, 20, (20, 2))]), np.repeat(rng.uniform(0, 9, (60, 2)), 100, axis=0)):
        taken.clear()
        kernels.hdbscan(points, 5)
        assert 0 < sum(taken) < 6000 * 6000 / 6
    places = np.round(rng.uniform(0, 9, (150, 2)), 1)
    points = np.repeat(places, rng.integers(1, 9, len(places)), axis=0)
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "window int, id long, x double, y double")
    want = [(i, int(c)) for i, c in enumerate(kernels.hdbscan(points, 5)) if c >= 0]
    for size in (20, 1000):
        got = [(r["id"], r["cluster"]) for r in density.clusters(df, ["window"], 5, size).collect()]
        assert sorted(got) == want and len({c for _, c in want}) > 3  # the numbers too


def test_tree_of_equal_weights_is_the_one_of_least_names():
    rng = np.random.default_rng(8)
    for n in (1, 2, 150):
        points = rng.permutation(np.unique(np.round(rng.uniform(0, 2, (n, 2)), 1), axis=0))
        copies, names = rng.integers(1, 4, len(points)), rng.permutation(len(points)) * 3
        d = planar.between(*points.T, *points.T)
        core = planar.cores(points, copies, 5)
        assert core.tolist() == [np.sort(np.repeat(row, copies))[4] if copies.sum() >= 5 else np.inf for row in d]
        reach = np.maximum(np.maximum(d, core[:, None]), core)
        home, want = list(range(len(points))), []
        for w, a, b in sorted((reach[i, j], *sorted((int(names[i]), int(names[j])))) for i in range(len(points)) for j in range(i)):
            i, j = home[names.tolist().index(a)], home[names.tolist().index(b)]
            if i != j:
                home = [i if h == j else h for h in home]
                want.append((w, a, b))
        w, a, b = planar.spanning_tree(points, core, names)
        assert sorted((x, *sorted((int(names[i]), int(names[j])))) for x, i, j in zip(w, a, b)) == want


def test_spots_are_matched_in_order(spark):
    rng = np.random.default_rng(2)
    rows = [("d", c * 2000 + i, float(lat), float(lon), bool(c)) for c in (0, 1) for i, (lat, lon) in enumerate(rng.uniform((13, 80), (13.6, 80.6), (700, 2)))]
    km = lambda a, b: 2 * 6371 * np.arcsin(np.sqrt(np.sin(np.radians(b[2] - a[2]) / 2) ** 2 + np.cos(np.radians(a[2])) * np.cos(np.radians(b[2])) * np.sin(np.radians(b[3] - a[3]) / 2) ** 2))
    free, want = [r for r in rows if not r[4]], []
    for r in (r for r in rows if r[4]):
        near = next((p for p in free if km(r, p) <= 3.0), None)
        free = [p for p in free if p is not near]
        want.append((r[1], "persisting" if near else "new"))
    want += [(p[1], "cleared") for p in free]
    got = kernels.match_hotspots(spark.createDataFrame(rows, "day string, id long, lat double, lon double, current boolean"), ["day"])
    assert sorted((r.id, r.movement) for r in got.collect()) == sorted(want) and len({m for _, m in want}) == 3


def test_missing_people_match_by_classes(spark):
    """People alike are one row of matches, however many they are, and their members give all pairs with their ranks."""
    names = ["Kavya Raman", "Kavia Raman", "kavya  ramon", "Anbu", "Anbu K", None]
    people = [(i, names[i % 6], i % 2, *((13.0 + i % 4 / 50, 80.0) if i % 5 else (None, None))) for i in range(1200)]
    df = spark.createDataFrame(people, "id long, name string, kind int, lat double, lon double")
    classed = recovery.same_people(df)
    matches = recovery.class_matches(classed, 0.72, 5.0).collect()
    assert len({r["class"] for r in classed.collect()}) == 18 and len(matches) < 18 * 18
    members = {}
    for r in classed.collect():
        members.setdefault(r["class"], []).append(r.id)
    got = {}
    for r in matches:
        assert r.candidates == len(members[r.other_class])
        for i in members[r["class"]]:
            got.setdefault(i, []).extend((-r.name_score, j, r.distance_km, r.first_rank) for j in members[r.other_class])
    assert sum(map(len, got.values())) > 100 * len(matches)
    seen = {}
    for r in recovery.ranked_matches(df.filter("id < 240"), 0.72, 5.0).collect():
        seen.setdefault(r.id, []).append((r.rank, -r.name_score, r.candidate, r.distance_km))
    assert len(seen) == 200
    for i, rows in seen.items():
        rows.sort()
        assert [r[1:] for r in rows] == sorted((s, j, km) for s, j, km, _ in got[i] if j < 240)
    for rows in got.values():
        scores = sorted(s for s, *_ in rows)
        assert all(first == 1 + scores.index(s) for s, _, _, first in rows)


def test_missing_matches_are_whole(spark):
    people = {r.id: r for r in V.persons(spark, "/root/testdata/sf0.001").collect()}
    rows = catalog.QUERIES["missing_matches"](spark, "/root/testdata/sf0.001").collect()
    members, links, got = {}, {}, set()
    for r in rows:
        if r["row"] == "member":
            members.setdefault(r["class"], []).append(r.id)
            links[r.id] = r.links
    assert sorted(links) == sorted(people)
    for r in rows:
        if r["row"] == "match":
            got |= {(i, j, r.name_score, r.distance_km is None) for i in members[r["class"]] for j in members[r.other_class]}
    place = lambda k: ((1280 + k * 31 % 60) / 100, (7990 + k * 31 % 37) / 100)
    want = set()
    for i, a in people.items():
        for j, b in people.items():
            score = SequenceMatcher(None, a.name.strip().lower(), b.name.strip().lower()).ratio()
            if a.kind != b.kind and score >= 0.72:
                loose = i % 7 == 0 or j % 7 == 0
                (p, q), (u, v) = (map(math.radians, place(k)) for k in (i, j))
                km = 2 * 6371 * math.asin(math.sqrt(math.sin((u - p) / 2) ** 2 + math.cos(p) * math.cos(u) * math.sin((v - q) / 2) ** 2))
                if loose or km <= 5:
                    want.add((i, j, round(score, 3), loose))
    assert got == want and links == {i: sum(w[0] == i for w in want) for i in people}


def test_leaders_are_read_in_batches(spark):
    """No task takes a group whole; clusters go on from one batch of reports to the next."""
    rng = np.random.default_rng(4)
    texts = np.repeat(np.eye(6), 3, axis=0) + rng.normal(0, 0.3, (18, 6))
    rows = [(i % 2, i, 1000 - i // 3, int(k), texts[k].tolist()) for i, k in enumerate(rng.integers(0, 18, 300))]
    rows += [(0, 900, 5, 18, [0.0] * 6), (2, 901, 5, 19, [1.0] * 6)]
    want = set()
    for g in (0, 1, 2):
        clusters = []
        for _, i, _, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            v = np.array(v)
            near = [(kernels._cosine(m, v), c) for c, (m, _) in enumerate(clusters)]
            if near and max(near)[0] >= 0.55:
                c = max(near)[1]
                m, held = clusters[c]
                clusters[c] = (m * len(held) + v) / (len(held) + 1), [*held, (i, v)]
            else:
                clusters.append((v, [(i, v)]))
        for m, held in clusters:
            if len(held) >= 3:
                best = int(np.argmax([kernels._cosine(v, m) for _, v in held]))
                want |= {(g, held[0][0], i, k == best) for k, (i, _) in enumerate(held)}
    df = spark.createDataFrame(rows, "g int, id long, t long, said int, v array<double>").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for key in ("id", "said"):
            assert {r[:] for r in kernels.leader_clusters(df, ["g"], key=key).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(want) > 200 and "FlatMapGroupsInPandas" not in plan(kernels.leader_clusters(df, ["g"]))
