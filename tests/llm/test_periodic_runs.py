"""Runs against every period tried at every place, and the defined results of odd rows."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from littoral.llm import queries
from littoral.llm.periodic_runs import RUN, Extensions, find_runs, runs_of


def brute_runs(words, least=24, times=3):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((start, length, p) for (start, length), p in found.items())


def random_text(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        alphabet, period, n = rng.choice([1, 2, 3, 50]), rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 30, 60]), rng.randint(1, 150)
        base = [f"w{rng.randint(0, alphabet)}" for _ in range(period)]
        words += (base * n)[:n] if rng.random() < 0.7 else [f"w{rng.randint(0, alphabet)}" for _ in range(n)]
    return rng.choice([" ", "\n", " \t "]).join(words)


@pytest.mark.parametrize("least,times", [(24, 3), (10, 2), (5, 4)])
def test_every_run_is_found(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randint(1, 6))]
        counts, found = runs_of(pa.array(texts), least, times)
        for k, text in enumerate(texts):
            assert counts[k] == len(text.split())
            assert sorted(map(tuple, found[k].tolist() if k in found else [])) == brute_runs(text.split(), least, times)


def test_extensions():
    import numpy as np

    rng = np.random.default_rng(3)
    s = np.concatenate((rng.integers(0, 2, 200), [2], np.tile([0, 1, 1], 40), [3]))
    ahead = Extensions(s)
    x, y = rng.integers(0, len(s), (2, 500))
    x, y = x[x != y], y[x != y]
    for a, b, n in zip(x, y, ahead(x, y)):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        assert k == n


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.IntegerType()), T.StructField("n", T.StringType())])
    long = " ".join(["a b c"] * 60_000)
    rows = [(1, None, 1, "x"), (2, "", 2, None), (None, "x " * 24, 3, "y"), (3, "x " * 23, 4, ""), (3, "x " * 23, 4, ""), (4, long, 5, "z"), (5, " \n\t ", 6, "z")]
    got = {(r["doc_id"], r["n"]): r for r in find_runs(spark.createDataFrame(rows, schema)).collect()}
    assert got[1, "x"]["runs"] == [] and got[1, "x"]["collapsed"] == "" and got[1, "x"]["best"] is None and got[1, "x"]["n_words"] == 0
    assert got[2, None]["runs"] == [] and got[5, "z"]["n_words"] == 0
    assert tuple(got[None, "y"]["best"]) == (0, 24, 1) and got[None, "y"]["collapsed"] == "x"
    assert got[3, ""]["runs"] == [] and got[3, ""]["collapsed"] == " ".join("x" * 23)
    assert [tuple(r) for r in got[4, "z"]["runs"]] == [(0, 180_000, 3)] and got[4, "z"]["collapsed"] == "a b c"
    empty = find_runs(spark.createDataFrame([], schema))
    assert empty.count() == 0 and dict(empty.dtypes)["best"] == RUN.simpleString()


def test_ties_take_the_smallest_start(spark):
    text = " ".join(["a"] * 30 + ["-"] + ["b"] * 30 + ["+"] + ["c", "d"] * 30)
    (row,) = find_runs(spark.createDataFrame([(text,)], ["text"])).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 30, 1), (31, 30, 1), (62, 60, 2)] and tuple(row["best"]) == (0, 30, 1)
    assert row["collapsed"] == "a - b + c d"


def test_planted_periods(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(str(rng.random()) for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(None, "a b"), (7, None)]
    got = {(r[0], r[1]) for r in queries._with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, text in rows:
        words = (text or "").split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[:a] + [words[a + (k - a) % p] for k in range(a, n)])
        want.add((i, text))
    assert got == want
