"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Grades run from 0 (worst) to J. One weight vector w is shared by all grades, and ordered thresholds t_1 < ... < t_J give
P(grade >= j) = sigmoid(w.x - t_j). The features x of a text are hashed: its distinct words, and the shares of its words
that have each shape (case, digits, punctuation), and the share of words that repeat the one before.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import draw

#: Hash buckets of words; shapes come after them, and the repeat share last. Shares are scaled, to weigh as much as words.
WORDS, SHAPES, SCALE = 1 << 26, 1 << 16, 10.0
REPEATS = WORDS + SHAPES
_LETTERS, _SMALL, _DIGITS, _AGAIN = map(re.compile, (r"[^\W\d_]+", r"[a-zß-öø-ÿ]", r"\d+", r"(.)\1+"))


def word_bucket(word: str) -> int:
    return zlib.crc32(word.lower().strip(".,").encode()) % WORDS


def shape_bucket(word: str) -> int:
    """Runs of letters become a, or A if none is small, digits 9, and repeats one character."""
    shape = _LETTERS.sub(lambda m: "a" if _SMALL.search(m[0]) else "A", word)
    shape = _AGAIN.sub(r"\1", _DIGITS.sub("9", shape))
    return WORDS + zlib.crc32(shape.encode()) % SHAPES


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Sparse features of a whole text; none for null or blank texts."""
    words = (text or "").split()
    if not words:
        return [], []
    n = len(words)
    counts: Counter[int] = Counter(map(word_bucket, set(words)))
    shapes: Counter[int] = Counter()
    for word, k in Counter(words).items():
        shapes[shape_bucket(word)] += k
    repeats = sum(map(eq, words, words[1:]))
    return [*counts, *shapes, REPEATS], [*map(float, counts.values()), *(SCALE * k / n for k in shapes.values()), SCALE * repeats / n]


@dataclass
class OrdinalModel:
    """weights: bucket -> weight, only of buckets seen in enough documents. thresholds: ascending, one fewer than grades."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_cols: int, n_grades: int, l2: float, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an l2 penalty, by full-batch Adam. Gaps between thresholds are kept positive by exp."""
    n, j = len(grades), n_grades - 1
    above = grades[:, None] > np.arange(j)[None, :]
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)))
    p = np.concatenate((np.zeros(n_cols), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    low, high = np.maximum(grades - 1, 0), np.minimum(grades, j - 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, t = p[:n_cols], np.cumsum(np.concatenate((p[n_cols : n_cols + 1], np.exp(p[n_cols + 1 :]))))
        z = np.bincount(rows, vals * w[cols], n)
        # P(grade = g) = s(z - t_g) - s(z - t_{g+1}), with the ends at 1 and 0
        a = np.where(grades > 0, sigmoid(z - t[low]), 1.0)
        b = np.where(grades < j, sigmoid(z - t[high]), 0.0)
        mass = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / mass / n, b * (1 - b) / mass / n
        gz = -(da - db)
        gt = np.bincount(low, np.where(grades > 0, da, 0), j) - np.bincount(high, np.where(grades < j, db, 0), j)
        tail = np.cumsum(gt[::-1])[::-1]
        gap = tail.copy()
        gap[1:] *= np.exp(p[n_cols + 1 :])
        g = np.concatenate((np.bincount(cols, vals * gz[rows], n_cols) + l2 * w, gap))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:n_cols], np.cumsum(np.concatenate((p[n_cols : n_cols + 1], np.exp(p[n_cols + 1 :]))))


def fit(docs: DataFrame, ratings: DataFrame, max_rows: int = 10_000, min_docs: int = 5, l2: float = 2e-4, steps: int = 250, rate: float = 0.05) -> OrdinalModel:
    """Learns from docs (doc_id, text) and ratings (doc_id, grade); the lowest grade and the text
    that sorts first count if a document has several.

    ``max_rows`` bounds the sample: about that many rated documents, those with the lowest hash of doc_id. Their sparse
    features are fitted on the driver. Ratings with a null are left out; with fewer than two grades, nothing is learnt.
    """
    rated = ratings.select("doc_id", "grade").dropna().groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    total = ratings.count()
    chosen = rated.filter(draw("quality", "doc_id") < min(1.0, max_rows / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            columns = [b.column("grade"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["grade", "cols", "vals"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    got = sample.select("grade", "text").mapInArrow(run, "grade int, cols array<int>, vals array<float>").toArrow()
    grades = got.column("grade").to_numpy()
    if len(set(grades.tolist())) < 2:
        return OrdinalModel()
    table = got.combine_chunks()
    cols, vals = (table.column(c).combine_chunks() for c in ("cols", "vals"))
    rows = np.repeat(np.arange(len(grades)), cols.value_lengths().to_numpy())
    cols, vals = cols.flatten().to_numpy(), vals.flatten().to_numpy()
    buckets, number, seen = np.unique(cols, return_inverse=True, return_counts=True)
    often = (seen >= min_docs)[number]
    kept, number = np.unique(number[often], return_inverse=True)
    w, t = fit_ordinal(rows[often], number, vals[often], grades, len(kept), int(grades.max()) + 1, l2, steps, rate)
    return OrdinalModel(dict(zip(buckets[kept].tolist(), w.tolist())), t.tolist())


class _Scorer:
    def __init__(self, model: OrdinalModel, max_entries: int = 150_000):
        self.weights, self.max_entries = model.weights, max_entries
        self.word: dict[str, float] = {}
        self.shape: dict[str, float] = {}

    def __call__(self, text: str | None) -> float:
        words = (text or "").split()
        if not words:
            return 0.0
        distinct = set(words)
        get = self.weights.get
        for w in distinct.difference(self.word):
            self.word[w] = get(word_bucket(w), 0.0)
            self.shape[w] = get(shape_bucket(w), 0.0)
        repeats = sum(map(eq, words, words[1:]))
        z = sum(map(self.word.__getitem__, distinct))
        z += SCALE / len(words) * (sum(map(self.shape.__getitem__, words)) + repeats * get(REPEATS, 0.0))
        if len(self.word) > self.max_entries:
            self.word, self.shape = {}, {}
        return z


def grade(df: DataFrame, model: OrdinalModel, accept_from: int | None = None, cutoff: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds expected_grade, p_tail (probability of grade ``accept_from`` or more, by default the top grade) and keep
    (p_tail at least ``cutoff``).

    Null and blank texts hold nothing to read: expected grade 0, p_tail 0, not kept. Where nothing was learnt every
    other text is kept, with p_tail 1. Columns of those names are replaced. No shuffle.
    """
    names = ["expected_grade", "p_tail", "keep"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    new = [T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    schema = T.StructType([*(df.schema[c] for c in keep), *new])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, t = _Scorer(held.value), np.array(held.value.thresholds)
        tail = (len(t) if accept_from is None else accept_from) - 1
        for b in batches:
            texts = b.column(text).to_pylist()
            z = np.array([scorer(x) for x in texts])
            blank = np.array([not x or x.isspace() for x in texts], dtype=bool)
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -40, 40)))
            p = np.where(blank, 0.0, above[:, tail] if len(t) else 1.0)
            expected = np.where(blank, 0.0, above.sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(expected), pa.array(p), pa.array(p >= cutoff)], schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two marks of ``labels``: 2 for good, 1 if it is of low quality or toxic, 0 if both."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
