"""Distributed density clusters against the kernel that sees all points of a window."""

import numpy as np
import pytest

from littoral.operators import density, kernels


def blobs(rng, n):
    centres = rng.uniform(-40, 40, (rng.integers(2, 7), 2))
    parts = [c + rng.normal(0, rng.uniform(0.2, 4), (n // len(centres), 2)) for c in centres]
    return np.concatenate([*parts, rng.uniform(-80, 80, (n // 10, 2)), [[500.0, 500.0]]])


def partition(labels):
    groups = {}
    for i, c in labels.items():
        groups.setdefault(c, set()).add(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("size", [12, 40, 1000])
def test_equal_to_the_kernel(spark, size):
    rng = np.random.default_rng(size)
    sets = [blobs(rng, 150), blobs(rng, 300), rng.uniform(0, 1, (8, 2)), rng.uniform(0, 1, (12, 2)), np.repeat(rng.uniform(0, 9, (6, 2)), 20, axis=0)]
    rows = [(w, int(i), float(x), float(y)) for w, p in enumerate(sets) for i, (x, y) in enumerate(p)]
    got = density.clusters(spark.createDataFrame(rows, "window int, id long, x double, y double"), ["window"], 5, size).collect()
    for w, p in enumerate(sets):
        label = kernels.hdbscan(p, 5)
        want = partition({i: c for i, c in enumerate(label.tolist()) if c >= 0})
        assert partition({r["id"]: r["cluster"] for r in got if r["window"] == w}) == want, (size, w)
    assert len({r["window"] for r in got}) >= 3


def test_far_tiles_are_not_compared(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([c + rng.normal(0, 0.5, (100, 2)) for c in ([0, 0], [50, 0], [0, 50], [50, 50], [100, 100], [150, 20], [20, 150], [90, 200])])
    rows = [(0, int(i), float(x), float(y)) for i, (x, y) in enumerate(p)]
    packed = density.tiles(spark.createDataFrame(rows, "window int, id long, x double, y double"), ["window"], 25)
    sizes = [len(r["ids"]) for r in packed.collect()]
    assert sum(sizes) == 800 and max(sizes) <= 75
    cores = density.core_distances(packed, ["window"], 5)
    edges = density.tree_edges(packed.join(cores, ["window", "tile"]), ["window"])
    assert edges.count() < 800 * len(sizes) / 3  # each tile would meet every other
