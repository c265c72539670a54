import random

import numpy as np

from littoral.llm import jaccard_join, queries


def brute(texts, t=0.8):
    sets = []
    for text in texts:
        words = (text or "").encode().split()
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    n = len(texts)
    links, root = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, root[i], links[i]) for i in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, sid string").repartition(3)


def cases(spark, copies=40):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()]
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words[: rng.randint(240, 300)]))
    return texts + [None, None, "", " ", "a b", "a b", "a  b", "a b c d e", "a b c d e f", texts[-1], texts[0] + " more", "q " * 30_000]


def test_against_brute_force(spark):
    texts = cases(spark)
    got = sorted(map(tuple, jaccard_join.near_duplicates(frame(spark, texts)).collect()))
    assert got == brute(texts)


def test_blocks_of_large_groups(spark):
    texts = cases(spark, 90)
    got = sorted(map(tuple, jaccard_join.near_duplicates(frame(spark, texts), block=7, crowd=4).collect()))
    assert got == brute(texts)


def test_few_very_long_near_copies(spark):
    """Groups of two and three texts that fill several chunks by their shingles, so that some chunks stay empty."""
    texts = []
    for g in range(16):
        words = [f"g{g}w{i}" for i in range(1500 + 20 * g)]
        texts += [" ".join([*words, f"end{k}"]) for k in range(2 + g % 2)]
    got = sorted(map(tuple, jaccard_join.near_duplicates(frame(spark, texts), shingles=2000).collect()))
    assert got == brute(texts)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    df = frame(spark, ["one two three four five six"])
    assert sorted(map(tuple, jaccard_join.near_duplicates(df.union(df)).collect())) == [(0, 0, 1), (0, 0, 1)]
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_ngram_jaccard_join(spark, str(tmp_path)).count() == 0


def test_compare_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    m = jaccard_join.compare(sets, sets, 0.6)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x = len(np.intersect1d(a, b))
            assert m[i, j] == (x >= 0.6 * (len(a) + len(b) - x))


def test_recall_at_the_threshold(spark):
    """400 pairs whose similarity lies just above the threshold, among crowded nodes: at least the target share is met."""
    rng = random.Random(8)
    texts, pairs = [], 0
    for k in range(400):
        words = [f"p{k}w{i}" for i in range(100)]
        changed = list(words)
        changed[30], changed[70] = f"p{k}a", f"p{k}b"  # 10 of 96 shingles differ: similarity 86 / 106
        texts += [" ".join(words), " ".join(changed)]
        pairs += 1
    texts += [" ".join(["boiler", "plate", "text", "of", "many", "pages"] * 3 + [f"n{rng.random()}"]) for _ in range(300)]
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(frame(spark, texts), crowd=8).collect()}
    found = sum(got[2 * k + 1].class_id == 2 * k and got[2 * k].n_links == 1 for k in range(pairs))
    assert found >= 0.99 * pairs


def test_null_ids_and_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long, 1, 2), (7, long, 1, 2), (7, long + " more", 1, 2), (None, None, 1, 2), (8, "", 1, 2), (9, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, n int")
    got = sorted(map(tuple, jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7, 2), (7, 7, 2), (7, 7, 2), (None, None, 0), (8, 8, 0), (9, 9, 0)], key=str)
