"""Retrieval against all pairs, how much of it is spared, and documents kept up to date."""

import json

import numpy as np
import pytest

from littoral.operators import retrieval
from littoral.sources import registry


def clustered(rng, n, dims=16, centres=12, noise=0.15):
    c = rng.normal(size=(centres, dims))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c[rng.integers(0, centres, n)] + rng.normal(0, noise / np.sqrt(dims), (n, dims))


@pytest.mark.parametrize("seed,least", [(0, 0.28), (1, 0.9), (2, -1.0)])
def test_equal_to_all_pairs(spark, seed, least):
    rng = np.random.default_rng(seed)
    x = clustered(rng, 300) if seed else rng.normal(size=(300, 16))
    x[7], x[8] = x[9], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    got = sorted((r["q"], r["id"], round(r["s"], 9)) for r in retrieval.nearest(df, df.filter("id % 10 = 0"), "id", "v", 4, least, pivots=10, size=16).collect())
    norm = np.linalg.norm(x, axis=1)
    want = []
    for q in range(0, 300, 10):
        s = {i: float(x[q] @ x[i] / norm[q] / norm[i]) for i in range(300) if i != q and norm[i] and norm[q]}
        best = sorted(((-v, i) for i, v in s.items() if v >= least))[:4]
        want += [(q, i, round(-v, 9)) for v, i in best]
    assert got == sorted(want)


def test_blocks_out_of_reach_are_skipped(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(rng, 2_000))], "id long, v array<double>")
    rows = retrieval.usable(df, "id", "v")
    cells = retrieval.Cells(rows, 32)
    asks = rows.filter("key % 20 = 0")
    opened = cells.opened(asks, 0.7).count()
    assert opened < asks.count() * len(cells.sizes) / 3


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert retrieval.nearest(none, none, "id", "v", 3, 0.1).count() == 0


def test_documents_follow_the_registry(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("key: tide\nfaq:\n  - {id: t1, title: T, content: high water, lang: en}\n  - {id: t2, title: U, content: low water}\n")
    (tmp_path / "b.yaml").write_text("key: storm\n")
    entries = registry.faq_entries(spark, str(tmp_path))
    assert sorted(tuple(r) for r in entries.collect()) == [("t1", "T", "high water", "en"), ("t2", "U", "low water", "en")]
    stored = spark.createDataFrame([("t1", "old", "high water", "en", [1.0]), ("t2", "U", "other", "en", [2.0]), ("x", "X", "kept", "ta", [3.0])], "id string, title string, content string, lang string, embedding array<double>")
    got = {r["id"]: tuple(r)[1:] for r in retrieval.upserted(stored, entries).collect()}
    assert got == {"t1": ("T", "high water", "en", [1.0]), "t2": ("U", "low water", "en", None), "x": ("X", "kept", "ta", [3.0])}
    once = retrieval.upserted(retrieval.upserted(stored.limit(0), entries), entries).collect()
    assert len(once) == 2 and all(r["embedding"] is None for r in once)


def test_seeds_load_once(spark, tmp_path):
    table, source = str(tmp_path / "shelters"), str(tmp_path / "s.json")
    schema = "name string, lat double, lon double, capacity long, status string"
    assert not registry.seed_once(spark, table, source, schema)
    (tmp_path / "s.json").write_text(json.dumps([{"name": "a", "lat": 1.0, "lon": 2.0}, {"name": "b", "lat": 1.0, "lon": 2.0, "status": "full"}]))
    assert registry.seed_once(spark, table, source, schema, {"status": "open"})
    (tmp_path / "s.json").write_text(json.dumps([{"name": "c", "lat": 1.0, "lon": 2.0}]))
    assert not registry.seed_once(spark, table, source, schema)
    assert sorted((r["name"], r["status"]) for r in spark.read.parquet(table).collect()) == [("a", "open"), ("b", "full")]


def test_labels_fall_back(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("key: red_tide\nmenu_label: {en: Red tide, ta: T}\nspeech_label: {en: red tide, ta: S}\nalert_label_en: Red tide seen\n")
    (tmp_path / "b.yaml").write_text("key: odd_one\n")
    known = registry.labels(spark, str(tmp_path))
    assert {tuple(r) for r in known.filter("hazard_type = 'red_tide'").collect()} == {("red_tide", "en", "Red tide", "red tide", "Red tide seen"), ("red_tide", "ta", "T", "S", "S"), ("red_tide", "te", "Red tide", "red tide", "Red tide seen")}
    asks = spark.createDataFrame([(1, "red_tide", "ta"), (2, "red_tide", "hi"), (3, "odd_one", "te"), (4, "no_such", "en"), (5, None, None)], "id int, hazard_type string, lang string")
    got = {r["id"]: (r["menu"], r["speech"], r["alert"]) for r in registry.labelled(asks, known).collect()}
    assert got == {1: ("T", "S", "S"), 2: ("Red tide", "red tide", "Red tide seen"), 3: ("Odd One",) * 3, 4: ("No Such",) * 3, 5: (None,) * 3}
