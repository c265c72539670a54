"""Registered queries that have no SQL, against plain Python over all rows of a small table."""

import numpy as np

from littoral.operators import kernels
from littoral.plans import catalog
from littoral.plans import views as V

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
HOUR = 3_600_000_000
#: Queries whose rules are tested elsewhere, on the operators that they consist of.
ELSEWHERE = {
    "missing_matches": "test_operators.test_ranked_matches",
    "linear_probe": "test_probes",
    "federated_classifier": "test_operators.test_federated_fits",
    "forecast_backtest": "test_forecasts",
    "forecast_horizon_pick": "test_forecasts",
    "hotspot_movement": "test_hotspots",
}
HERE = {"incident_merge", "incident_table", "incident_projections", "narrative_clusters", "hotspots", "harmonic_forecast", *ELSEWHERE}


def run(spark, name, d):
    return catalog.QUERIES[name](spark, d).collect()


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if size == 0 else float(a @ b) / size


def merged(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in V.table(spark, SMALL, "embeddings").collect()}
    home, books = {}, {}
    for r in sorted(V.reports(spark, SMALL).collect(), key=lambda r: (r["t"], r["id"])):
        book = books.setdefault(r["hazard_type"], [])
        v = vectors.get(r["id"])
        open_ones = sorted((i for i in book if i["seen"] >= r["t"] - 6 * HOUR), key=lambda i: (-i["seen"], i["id"]))[:50]
        for i in open_ones:
            near = any(abs(a - r["row"]) <= 1 and abs(b - r["col"]) <= 1 for a, b in i["cells"])
            if near and (v is None or i["v"] is None or cosine(v, i["v"]) >= 0.5):
                break
        else:
            i = {"id": r["id"], "n": 0, "v": None, "cells": set(), "seen": 0}
            book.append(i)
        if v is not None:
            mean = v if i["v"] is None else (i["v"] * i["n"] + v) / (i["n"] + 1)
            i["v"] = v if i["v"] is None else mean / (np.linalg.norm(mean) or 1)
        i["n"], i["seen"] = i["n"] + 1, max(i["seen"], r["t"])
        i["cells"].add((r["row"], r["col"]))
        home[r["id"]] = i
    return home


def test_incident_merge(spark):
    home = merged(spark)
    got = run(spark, "incident_merge", SMALL)
    assert {r["id"]: (r["incident"], r["n"]) for r in got} == {k: (i["id"], i["n"]) for k, i in home.items()}


def test_incident_tables(spark):
    home, reports = merged(spark), {r["id"]: r for r in V.reports(spark, SMALL).collect()}
    members = {}
    for id, i in home.items():
        members.setdefault(i["id"], []).append(reports[id])
    want = {}
    for incident, rows in members.items():
        said = {r["status"] for r in rows}
        status = "rejected" if said == {"rejected"} else next((s for s in ("verified", "corroborated") if s in said), "new")
        want[incident] = rows[0]["hazard_type"], len(rows), min(r["t"] for r in rows), max(r["t"] for r in rows), len({(r["row"], r["col"]) for r in rows}), status
    got = {r["incident"]: r for r in run(spark, "incident_table", SMALL)}
    assert {k: tuple(r[c] for c in ("hazard_type", "n", "first_seen", "last_seen", "n_cells", "status")) for k, r in got.items()} == want
    for k, rows in members.items():
        assert abs(got[k]["lat"] - np.mean([float(r["lat"]) for r in rows])) < 1e-5
    now = max(r["t"] for r in reports.values())
    ahead = set()
    for k, rows in members.items():
        if want[k][3] >= now - 6 * HOUR and want[k][5] != "rejected":
            own = {(r["row"], r["col"]) for r in rows}
            ahead |= {(k, a + i, b + j) for a, b in own for i in (-1, 0, 1) for j in (-1, 0, 1) if (a + i, b + j) not in own}
    assert ahead and {(r["incident"], r["row"], r["col"]) for r in run(spark, "incident_projections", SMALL)} == ahead


def test_narrative_clusters(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in V.table(spark, SMALL, "embeddings").collect()}
    halves = {}
    for r in sorted(V.reports(spark, SMALL).collect(), key=lambda r: (r["t"], r["id"])):
        said = r["id"] // 40 % (max(vectors) + 1)
        if said in vectors:
            halves.setdefault(r["t"] // (12 * HOUR), []).append((r["id"], vectors[said]))
    want = set()
    for half, rows in halves.items():
        clusters = []
        for id, v in rows:
            best = max(range(len(clusters)), key=lambda c: (cosine(clusters[c][0], v), c), default=None)
            if best is None or cosine(clusters[best][0], v) < 0.55:
                clusters.append((v, [id]))
            else:
                mean, ids = clusters[best]
                clusters[best] = (mean * len(ids) + v) / (len(ids) + 1), [*ids, id]
        want |= {(half, ids[0], i) for _, ids in clusters if len(ids) >= 3 for i in ids}
    assert {(r["half_day"], r["cluster"], r["id"]) for r in run(spark, "narrative_clusters", SMALL)} == want


def test_hotspots(spark):
    windows = {}
    for r in V.reports(spark, MIDDLE).filter("status <> 'rejected'").collect():
        lat, lon = float(r["lat"]) + r["id"] * 7919 % 1000 / 1e6, float(r["lon"]) + r["id"] * 104729 % 1000 / 1e6
        windows.setdefault(r["t"] // (6 * HOUR), []).append((r["id"], lat, lon))
    want = []
    for w, rows in windows.items():
        p = np.array([x[1:] for x in sorted(rows)])
        xy = np.column_stack((p[:, 1] * 111.320 * np.cos(np.radians(p[:, 0].mean())), p[:, 0] * 110.574))
        label = kernels.hdbscan(np.round(xy, 6), 5)
        want += [(w, int((label == c).sum()), *p[label == c].mean(axis=0)) for c in set(label.tolist()) - {-1}]
    spots = run(spark, "hotspots", MIDDLE)
    got = [(r["window"], r["n"], r["lat"], r["lon"]) for r in spots]
    order = lambda r: (r[0], r[1], round(float(r[2]), 4), round(float(r[3]), 4))
    assert len(got) == len(want) > 10
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=0, atol=2e-5), (a, b)

    moved = {}
    for now in sorted({r["window"] for r in spots} | {r["window"] + 1 for r in spots}):
        for hazard in {r["hazard_type"] for r in spots}:
            pick = lambda w: sorted((r["cluster"], r["lat"], r["lon"]) for r in spots if r["window"] == w and r["hazard_type"] == hazard)  # noqa: B023, E731
            free = pick(now - 1)
            for c, lat, lon in pick(now):
                near = next((p for p in free if km(lat, lon, *p[1:]) <= 3.0), None)
                free.remove(near) if near else None
                moved[now, hazard, c, True] = "persisting" if near else "new"
            for p in free:
                moved[now, hazard, p[0], False] = "cleared"
    rows = run(spark, "hotspot_movement", MIDDLE)
    assert sorted((r["window"], r["hazard_type"], r["id"], r["movement"]) for r in rows) == sorted((w, h, c, m) for (w, h, c, _), m in moved.items())


def km(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    return 2 * 6371 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))


def fit(t, y, at, end):
    terms = lambda h: np.column_stack([np.ones_like(h), h, *(f(2 * np.pi * h / p) for p in (12.42, 23.93) for f in (np.sin, np.cos))])
    return terms((at - end) / HOUR) @ np.linalg.lstsq(terms((t - end) / HOUR), y, rcond=None)[0]


def test_forecasts(spark):
    series = {}
    for r in V.readings(spark, SMALL).collect():
        series.setdefault((r["station_id"], r["variable"]), []).append((r["t"], r["event_id"], float(r["value"])))
    last = max(t for rows in series.values() for t, *_ in rows)

    def predicted(as_of):
        out = {}
        for key, rows in series.items():
            known = [x for x in rows if x[0] <= as_of]
            end = max(x[0] for x in known)
            t, y = (np.array([x[c] for x in known if x[0] >= end - 7 * 24 * HOUR], dtype=float) for c in (0, 2))
            if len(t) >= 20:
                at = end + np.arange(1, 13) * HOUR // 2
                out[key] = dict(zip(at.tolist(), fit(t, y, at, end)))
        return out

    want = predicted(last)
    got = {}
    for r in run(spark, "harmonic_forecast", SMALL):
        got.setdefault((r["station_id"], r["variable"]), {})[r["t"]] = r["value"]
    assert got.keys() == want.keys() and len(want) > 3
    for key, points in want.items():
        assert got[key].keys() == points.keys() and np.allclose([got[key][t] for t in points], list(points.values()), atol=1e-3)
    for r in run(spark, "forecast_horizon_pick", SMALL):
        points = want[r["station_id"], r["variable"]]
        assert r["t"] == min(points) + 2 * HOUR and abs(points[r["t"]] - r["value"]) < 1e-3
    rows = {(r["station_id"], r["variable"]): r for r in run(spark, "forecast_backtest", SMALL)}
    for key, points in predicted(last - 48 * HOUR).items():
        errors = []
        for t, value in points.items():
            near = [(abs(x[0] - t), x[1], x[2]) for x in series[key] if abs(x[0] - t) <= HOUR // 2]
            errors += [abs(min(near)[2] - value)] if near else []
        assert (key in rows) == bool(errors)
        if errors:
            assert rows[key]["scored"] == len(errors) and abs(rows[key]["mean_abs_error"] - np.mean(errors)) < 2e-3


def test_probes(spark):
    e = V.table(spark, MIDDLE, "embeddings")
    rows = catalog.QUERIES["linear_probe"](spark, MIDDLE).collect()
    n = sum(r["n"] for r in rows)
    assert 0.1 < n / e.count() < 0.3 and {r["label"] for r in rows} <= {r["label"] for r in e.select("label").distinct().collect()}
    assert all(0 <= r["hits"] <= r["n"] and 0 <= r["f1"] <= 1 and (r["f1"] > 0) == (r["hits"] > 0) for r in rows)


def test_every_query_has_sql_or_is_tested_here():
    assert {k for k in catalog.QUERIES if k not in catalog.ORACLE_SQL} <= HERE
