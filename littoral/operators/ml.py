"""Classifiers on embeddings: class prototypes, a linear probe, and its federated form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def prototype_class(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """vec_id, label: the class whose two most similar prototypes have the highest mean cosine (ties: smaller label).
    ``protos`` is one row with the array of (label, embedding), a few for each class."""
    each = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(protos))
    scored = F.transform("protos", lambda p: F.struct(p["label"].alias("label"), cosine(F.col("embedding"), p["embedding"]).alias("s")))
    labels = F.array_distinct(F.transform("scored", lambda x: x["label"]))
    best = lambda label: F.slice(F.sort_array(F.transform(F.filter("scored", lambda x: x["label"] == label), lambda x: x["s"]), False), 1, 2)
    mean = lambda top: F.aggregate(top, F.lit(0.0), lambda a, b: a + b) / F.size(top)
    ranked = F.transform(labels, lambda label: F.struct(F.round(mean(best(label)), 9).alias("m"), (-label).alias("back"), label.alias("label")))
    return each.select("vec_id", scored.alias("scored")).select("vec_id", F.array_max(ranked)["label"].alias("label"))


def _vectors(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(float)
    return np.column_stack([x, np.ones(len(x))])


def binary_fits(rows: DataFrame, classes: list[int], dim: int, steps: int = 12) -> dict[tuple[int, int], np.ndarray]:
    """(shard, class) to weights and intercept of a logistic fit, class against all others, on rows (shard, embedding,
    label), with half the squared weights as penalty. All fits take their Newton steps together: a step is one job that
    adds up gradients and second derivatives where the rows lie."""
    known = rows.groupBy("shard", "label").agg(F.count("*").alias("n")).collect()  # one row for each shard and class
    sizes: dict[int, int] = {}
    own: dict[tuple[int, int], int] = {}
    for r in known:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n
        own[r.shard, r.label] = r.n
    fits = {(s, c): np.zeros(dim + 1) for s in sizes for c in classes if 2 <= own.get((s, c), 0) <= sizes[s] - 2}
    ridge = np.append(np.ones(dim), 0.0)
    width = dim + 1
    for _ in range(steps):
        held = rows.sparkSession.sparkContext.broadcast(fits)

        def partly(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            sums = {k: np.zeros(width + width * width) for k in held.value}
            for pdf in frames:
                for s, part in pdf.groupby("shard"):
                    x, labels = _vectors(part["embedding"]), part["label"].to_numpy()
                    for (shard, c), w in held.value.items():
                        if shard == s:
                            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
                            sums[shard, c][:width] += x.T @ (p - (labels == c))
                            sums[shard, c][width:] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
            for (s, c), v in sums.items():
                yield pd.DataFrame({"shard": [s], "c": [c], "v": [v]})

        def summed(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "c": [pdf["c"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

        schema = "shard int, c int, v array<double>"
        moved = 0.0
        for r in rows.select("shard", "embedding", "label").mapInPandas(partly, schema).groupBy("shard", "c").applyInPandas(summed, schema).collect():
            v, w = np.array(r.v), fits[r.shard, r.c]
            step = np.linalg.solve(v[width:].reshape(width, width) + np.diag(ridge + 1e-9), v[:width] + ridge * w)
            fits[r.shard, r.c] = w - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break
    return fits


def federated_average(fits: dict[tuple[int, int], np.ndarray], sizes: dict[int, int], classes: list[int]) -> dict[int, np.ndarray]:
    """Each class's weights, averaged over the shards that could fit it by their number of rows."""
    out = {}
    for c in classes:
        able = [s for s, k in fits if k == c]
        if able:
            out[c] = np.average(np.stack([fits[s, c] for s in able]), axis=0, weights=[sizes[s] for s in able])
    return out


def _scored(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """label, n, hits, f1 by the class of the largest decision score (the first on ties)."""
    names, w = np.array(list(weights)), np.stack(list(weights.values()))

    @F.pandas_udf("int")
    def predicted(v: pd.Series) -> pd.Series:
        return pd.Series(names[(_vectors(v) @ w.T).argmax(axis=1)])

    return _f1(rows.select("label", predicted("embedding").alias("p")))


def _f1(predictions: DataFrame) -> DataFrame:
    pairs = predictions.groupBy("label", "p").agg(F.count("*").alias("n"))
    recall = pairs.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    named = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("named"))
    f1 = 2 * F.col("hits") / (F.col("n") + F.coalesce("named", F.lit(0)))
    return recall.join(named, "label", "left").select("label", "n", "hits", F.round(f1, 4).alias("f1"))


def _split(vectors: DataFrame, key: str):
    test = F.pmod(F.xxhash64(F.lit("split"), key), F.lit(5)) == 0
    return vectors.filter(~test), vectors.filter(test)


def _shape(vectors: DataFrame) -> tuple[list[int], int]:
    classes = sorted(r.label for r in vectors.select("label").distinct().collect())
    first = vectors.select(F.size("embedding").alias("d")).first()
    return classes, first.d if first else 0


def linear_probe(vectors: DataFrame, key: str) -> DataFrame:
    """label, n, hits, f1 on a hashed fifth of the rows, of a softmax regression fitted on the others by Spark's learner."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    classes, _ = _shape(vectors)
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("double") - 1
    train, test = _split(vectors.select(key, "label", number.alias("number"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), key)
    model = LogisticRegression(labelCol="number", family="multinomial", regParam=1e-3, maxIter=50, standardization=False).fit(train)
    named = F.array(*map(F.lit, classes))[F.col("prediction").cast("int")]
    return _f1(model.transform(test).select("label", named.alias("p")))


def federated_accuracy(vectors: DataFrame, key: str, shards: int) -> DataFrame:
    """label, n, hits, f1 and central_f1: one-vs-rest classifiers, fitted by shard and averaged, against the same fitted
    on all rows at once, on one split."""
    classes, dim = _shape(vectors)
    train, test = _split(vectors, key)
    own = train.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int"))
    sizes = {r.shard: r.n for r in own.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    federated = federated_average(binary_fits(own, classes, dim), sizes, classes)
    central = {c: w for (_, c), w in binary_fits(train.withColumn("shard", F.lit(0)), classes, dim).items()}
    both = _scored(test, federated)
    return both.join(_scored(test, central).select("label", F.col("f1").alias("central_f1")), "label", "left")
