"""Published cells, parents, centres and outlines; and what holds for every cell of the sphere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from littoral.functions import hexagons as H
from littoral.operators.spatial import haversine_km


def at(lat, lon, res):
    return H.cells_of(H.points(np.array([lat]), np.array([lon])), res)


#: Places, resolutions and cells from the grid's public documentation.
PUBLISHED = [
    (37.3615593, -122.0553238, 5, "85283473fffffff"),
    (37.3615593, -122.0553238, 7, "87283472bffffff"),
    (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
]
PENTAGONS = "8009fffffffffff 801dfffffffffff 8031fffffffffff 804dfffffffffff 8063fffffffffff 8075fffffffffff 807ffffffffffff 8091fffffffffff 80a7fffffffffff 80c3fffffffffff 80d7fffffffffff 80ebfffffffffff"


@pytest.mark.parametrize("lat,lon,res,cell", PUBLISHED)
def test_published_cells(lat, lon, res, cell):
    assert f"{at(lat, lon, res)[0]:x}" == cell


def test_published_centre_and_outline():
    cell = np.array([int("8928308280fffff", 16)])
    assert np.allclose(np.array(H.degrees(H.centres(cell))).ravel(), [37.77670234943567, -122.41845932318311], atol=1e-9)
    ring = [(37.775197782893386, -122.41719971841658), (37.77688044840226, -122.41612835779266), (37.778385004930925, -122.41738797617619)]
    assert np.allclose(np.stack(H.degrees(H.outlines(cell)), axis=-1)[0, :3], ring, atol=1e-9)
    assert np.allclose(np.array(H.degrees(H.centres(np.array([int("85283473fffffff", 16)])))).ravel(), [37.34579337536848, -121.97637597255124], atol=1e-9)


def test_pentagons():
    cells = np.array([int(x, 16) for x in PENTAGONS.split()])
    assert (H.cells_of(H.centres(cells), 0) == cells).all() and np.isnan(H.outlines(cells)[:, 5, 0]).all()
    assert [len(d) for d in H.disks(cells, 1)] == [6] * 12


def sphere(n, seed=1):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    corners = H.grid().sphere(np.arange(20), np.full(20, 2 + 0j))  # and places about the pentagons
    p = np.concatenate((p / np.linalg.norm(p, axis=1, keepdims=True), (corners[:, None] + 0.01 * p[: n // 20].reshape(1, -1, 3)).reshape(-1, 3)))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


@pytest.mark.parametrize("res", range(0, 16, 3))
def test_centres_lie_in_their_cells(res):
    p = sphere(20_000)
    cells = H.cells_of(p, res)
    middle = H.centres(cells)
    assert (H.cells_of(middle, res) == cells).all() and (cells >> 45 & 127).max() <= 121
    edge = H.outlines(cells)
    reach = np.nanmax(np.linalg.norm(edge - middle[:, None], axis=2), axis=1)
    assert (np.linalg.norm(p - middle, axis=1) <= reach * (1 + 1e-6) + 1e-12).all()


def test_every_cell_has_its_neighbours():
    cells = np.unique(H.cells_of(sphere(200_000), 2))
    assert len(cells) == 2 + 120 * 7**2
    disks = H.disks(cells, 1)
    assert sum(map(len, disks)) == 7 * len(cells) - 12  # each pentagon lacks one
    near = {c: set(d.tolist()) for c, d in zip(cells.tolist(), disks)}
    assert all(c in near[other] for c, d in near.items() for other in d)
    inland = at(13.0827, 80.2707, 8)
    assert [len(H.disks(inland, k)[0]) for k in range(5)] == [1 + 3 * k * (k + 1) for k in range(5)]


def test_columns(spark):
    rows = [(13.0827, 80.2707), (13.0830, 80.2710), (None, 80.0), (float("nan"), 1.0), (-33.9, 18.4)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("cell", H.cell(F.col("lat"), F.col("lon"), 8))
    df = df.select("*", H.centre("cell").alias("c"), H.ring("cell").alias("ring"), H.disk(F.col("cell"), 1).alias("disk"), H.parent(F.col("cell"), 6).alias("up"), H.name(F.col("cell")).alias("name"))
    df = df.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("c.lat"), F.col("c.lon")))
    got = df.collect()
    assert got[0]["cell"] == got[1]["cell"] and got[2]["cell"] is None and got[3]["cell"] is None and got[2]["ring"] is None and got[2]["disk"] is None
    for r in (got[0], got[4]):
        assert r["km"] < 1 and r["up"] == at(r["lat"], r["lon"], 6)[0] and r["name"] == f"{r['cell']:x}" and len(r["name"]) == 15
        assert len(r["ring"]) == 7 and r["ring"][0] == r["ring"][-1] and len(set(r["disk"])) == 7 and r["cell"] in r["disk"]


def test_parents_hold_most_of_their_children():
    cells = H.cells_of(sphere(5_000), 9)
    up = (cells & ~(15 << 52)) | (7 << 52) | ((1 << 24) - 1)
    same = H.cells_of(H.centres(cells), 7) == up
    assert 0.85 < same.mean() < 1  # children at the rim lie partly outside: only their digits tell the parent
