"""Merged incidents with more open ones than fifty."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from littoral.operators import kernels
from littoral.plans import catalog

MINUTE, HOUR = 60_000_000, 3_600_000_000


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Sixty reports of one cell that say different things; five hours after the first, one says the same as that. Eight
    hours after the first, there is one of another hazard."""
    d = tmp_path_factory.mktemp("crowded")
    times = [i * MINUTE for i in range(60)] + [5 * HOUR, 8 * HOUR]
    rows = [(i, t, 7, "click" if i < 61 else "view", 0.0) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double")
    events.withColumn("ts", F.timestamp_micros("t").cast("timestamp_ntz")).drop("t").write.parquet(str(d / "events.parquet"))
    vectors = [(i, [float(i % 60 == j) for j in range(64)]) for i in range(61)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(d / "embeddings.parquet"))
    return str(d)


def test_all_open_incidents_are_candidates(spark, crowded):
    got = {r.id: (r.incident, r.n) for r in catalog.QUERIES["incident_merge"](spark, crowded).collect()}
    assert got == {i: (i, 1) for i in range(62)} | {0: (0, 2), 60: (0, 2)}


def test_projections_are_of_all_open_incidents(spark, crowded):
    """The first incident was seen within six hours of the end only by the report that it got after sixty others."""
    got = {(r.incident, r.row, r.col) for r in catalog.QUERIES["incident_projections"](spark, crowded).collect()}
    around = {(1307 + a, 8000 + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} - {(1307, 8000)}
    assert got == {(i, *c) for i in (0, 61) for c in around}


def test_table_has_what_all_open_incidents_got(spark, crowded):
    got = {r.incident: (r.n, r.first_seen, r.last_seen) for r in catalog.QUERIES["incident_table"](spark, crowded).collect()}
    assert got == {i: (1, i * MINUTE, i * MINUTE) for i in range(1, 60)} | {0: (2, 0, 5 * HOUR), 61: (1, 8 * HOUR, 8 * HOUR)}


def test_oldest_open_incident_is_found_by_place(spark):
    """The only incident near a report without a vector, behind sixty newer ones, and closed six hours after it was seen."""
    far = [(i, i, 0, 9, [float(i == j) for j in range(61)]) for i in range(1, 61)]
    rows = [(0, 0, 0, 0, None), *far, (61, 100, 1, 1, None), (62, 6 * HOUR + 101, 0, 0, None)]
    df = spark.createDataFrame(rows, "id long, t long, row int, col int, v array<double>").withColumns({"h": F.lit("h"), "lat": F.lit(13.0), "lon": F.lit(80.0)})
    got = {r.id: r.incident for r in kernels.merge_incidents(df, ["h"]).collect()}
    assert got == {i: i for i in range(63)} | {61: 0}


def test_book_equals_plain_search():
    """Against a search of all open incidents one by one, with equal times, late reports and a book that is stored and read again."""
    for seed in range(8):
        rng = np.random.default_rng(seed)
        kinds, t = rng.normal(size=(200, 16)), np.sort(rng.integers(0, 60, 400)) * HOUR // 8 - rng.integers(0, 1 + seed % 2, 400) * HOUR
        book, plain, most = kernels.IncidentBook(), [], 0
        for k in range(400):
            v = None if rng.random() < 0.3 else kinds[rng.integers(200)]
            row, col = rng.integers(0, 6, 2).tolist()
            plain = sorted((i for i in plain if i["seen"] >= t[k] - 6 * HOUR), key=lambda i: (-i["seen"], i["id"]))
            fits = lambda i: any(abs(a - row) < 2 and abs(b - col) < 2 for a, b in i["cells"]) and (v is None or i["v"] is None or kernels._cosine(v, i["v"]) >= 0.5)
            home = next((i for i in plain if fits(i)), None)
            if home is None:
                home = {"id": k, "n": 0, "v": None, "cells": set(), "seen": t[k]}
                plain.append(home)
            if v is not None:
                w = v if home["v"] is None else (home["v"] * home["n"] + v) / (home["n"] + 1)
                home["v"] = w if home["v"] is None else w / np.linalg.norm(w)
            home["n"], home["seen"] = home["n"] + 1, max(home["seen"], t[k])
            home["cells"].add((row, col))
            got = book.assign({"id": k, "t": int(t[k]), "row": row, "col": col, "lat": 13.0, "lon": 80.0, "v": v})
            assert (got["id"], got["n"]) == (home["id"], home["n"])
            most = max(most, len(plain))
            if k % 100 == 50:
                book = kernels.IncidentBook().load(book.dump())
        assert most > 50
