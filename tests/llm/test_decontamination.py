"""Hits against windows met word by word, and the defined results of odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from littoral.llm.decontamination import find_hits, fingerprints, normal

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if n and item is not None else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, met = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[key]
        spans = [i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]
        out.append((doc, len(w), len(hit), list(zip(*spans)), sorted(met)))
    return out


def test_normal():
    texts = ["Ab-cÉ 9_z\x7f{~", None, "", "Über ÉA[B]`"]
    sliced = pa.array(["zz ", *texts])[1:]
    assert [t.split(" ") for t in normal(sliced).to_pylist()] == [re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).split(" ") for t in texts]


def test_every_window_keeps_its_minimum():
    h = np.random.default_rng(2).integers(0, 1 << 63, 400).astype(np.uint64)
    counts = np.array([100, 3, 0, 9, 10, 278])
    for width, gram in ((10, 5), (10, 10), (4, 5), (1, 5), (7, 3)):
        at, _, windows = fingerprints(h, counts, width, gram)
        ends = np.cumsum(counts)
        assert windows.tolist() == [i for i in range(400 - width + 1) if i + width <= ends[np.searchsorted(ends, i, side="right")]]
        held = set(at.tolist())
        for i in windows:
            assert held & set(range(i, i + width - min(gram, width) + 1))
        if width == 10 and gram == 5:
            assert len(at) < 0.35 * 400


def test_against_brute_force(spark):
    rng = random.Random(11)
    for trial, width in enumerate((10, 10, 6)):
        vocabulary = [f"w{k}" for k in range(rng.choice([2, 4, 40]))]
        text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        items = [(k, text(rng.choice([0, 1, 3, 7, 12, 30, 30]) if trial else rng.randint(10, 40))) for k in range(30)]
        items += [(100 + k, items[5][1] + " " + text(3)) for k in range(5)] + [(3, "again other words of this id here"), (None, "w0 w1"), (50, None)]
        docs = []
        for k in range(80):
            parts = [text(rng.randint(0, 20)) for _ in range(3)]
            parts += [" ".join((rng.choice(items)[1] or "").split()[rng.randint(0, 4) :]).upper() for _ in range(rng.randint(0, 2))]
            rng.shuffle(parts)
            docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts)))
        docs += [docs[0], docs[1], (None, items[0][1]), (200, None), (201, ""), (None, "w0 " * 12)]
        got = find_hits(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), width)
        rows = [(r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in got.collect()]
        assert sorted(rows, key=str) == sorted(brute(docs, items, width), key=str)


def test_odd_tables(spark):
    long = " ".join(f"x{k}" for k in range(150_000))
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, " ".join(f"x{k}" for k in range(70_000, 70_020)))], "item_id long, text string")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("spans", "text", "row", "note")] + [T.StructField("doc_id", T.LongType())])
    rows = [("s", long, "r", "long", 1), (None, "A B C D E F G H I J", None, "ten", 2), (None, "a b c d e f g h i", None, "nine", 3)]
    got = {r["note"]: r for r in find_hits(spark.createDataFrame(rows, schema), items).collect()}
    assert [tuple(s) for s in got["long"]["spans"]] == [(70_000, 70_020)] and got["long"]["items"] == ["2"]
    assert got["ten"]["n_hit"] == 10 and got["nine"]["n_hit"] == 0 and got["nine"]["items"] == []
    assert find_hits(spark.createDataFrame([], schema), items).count() == 0
    clean = find_hits(spark.createDataFrame(rows, schema), spark.createDataFrame([], items.schema)).collect()
    assert len(clean) == 3 and not any(r["n_hit"] for r in clean)
