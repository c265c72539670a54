"""Documents for questions: those of greatest cosine above a threshold, without meeting blocks that can't hold any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EPS = 1e-9


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v: rows whose vector has a direction."""
    v = F.col(vector).cast("array<double>")
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(F.col(key).alias("key"), v.alias("v")).filter(size.between(1e-300, 1e300))


class Cells:
    """Some rows as pivots, and of the rows nearest to each how many there are and the least cosine to it."""

    def __init__(self, rows: DataFrame, pivots: int) -> None:
        chosen = rows.orderBy(F.xxhash64("key"), "key").limit(pivots).toPandas()
        self.pivots = _units(chosen["v"]) if len(chosen) else np.zeros((0, 1))
        stats = self.placed(rows).groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).toPandas()  # one row a pivot
        self.sizes = dict(zip(stats["cell"].tolist(), stats["n"].tolist()))
        self.reach = np.full(len(self.pivots), -np.inf)
        self.reach[stats["cell"]] = np.arccos(np.clip(stats["least"], -1, 1))

    def placed(self, rows: DataFrame) -> DataFrame:
        """key, v, and the cell of the nearest pivot with the cosine to it."""
        pivots = self.pivots

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    s = _units(pdf["v"]) @ pivots.T
                    yield pdf.assign(cell=s.argmax(axis=1).astype("int32"), cosine=s.max(axis=1))

        return rows.mapInPandas(run, "key long, v array<double>, cell int, cosine double")

    def opened(self, questions: DataFrame, least: float) -> DataFrame:
        """key, v, cell: each question with the cells in which a row may have a cosine of ``least`` to it. By the triangle
        inequality of angles none is nearer than the question's angle to the pivot less the widest one in the cell."""
        pivots, reach = self.pivots, self.reach

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                if len(pdf):
                    angle = np.arccos(np.clip(_units(pdf["v"]) @ pivots.T, -1, 1))
                    may = (np.cos(np.maximum(0, angle - reach)) >= least - _EPS) & (reach > -np.inf)
                    at, cell = np.nonzero(may)
                    yield pdf.iloc[at].assign(cell=cell.astype("int32"))

        return questions.mapInPandas(run, "key long, v array<double>, cell int")


def _packed(rows: DataFrame, deals: F.Column, name: str) -> DataFrame:
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("key"), deals))
    return dealt.groupBy("cell", "deal").agg(F.collect_list("key").alias(f"{name}_keys"), F.collect_list("v").alias(f"{name}_v")).drop("deal")


def nearest(rows: DataFrame, questions: DataFrame, key: str, vector: str, k: int, least: float, pivots: int = 64, size: int = 2048) -> DataFrame:
    """q, key, s: for each question the k other rows of greatest cosine among those of at least ``least``, ties to the
    smaller key. Rows lie in cells about pivots, in blocks of about ``size``; a question meets the blocks of the cells
    that may hold such a row, and keeps k rows of each. Vectors without direction take no part."""
    known = usable(rows, key, vector)
    cells = Cells(known, pivots)
    spark = rows.sparkSession
    if not cells.sizes:
        return spark.createDataFrame([], f"q long, {key} long, s double")
    ways = F.create_map(*(F.lit(x) for cell, n in cells.sizes.items() for x in (cell, -(-n // size))))
    blocks = _packed(cells.placed(known).drop("cosine"), ways[F.col("cell")], "row")
    asks = usable(questions, key, vector)
    ask_ways = max(1, -(-asks.count() // size))
    met = blocks.join(_packed(cells.opened(asks, least), F.lit(ask_ways), "q"), "cell")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                q, own = np.asarray(r.q_keys), np.asarray(r.row_keys)
                s = _units(pd.Series(list(r.q_v))) @ _units(pd.Series(list(r.row_v))).T
                s[(q[:, None] == own[None, :]) | (s < least)] = -np.inf
                m = min(k, len(own))
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :m]
                out = pd.DataFrame({"q": np.repeat(q, m), key: own[order].ravel(), "s": np.take_along_axis(s, order, axis=1).ravel()})
                yield out[out["s"] > -np.inf]

    found = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.element_at("row_keys", 1)).mapInPandas(run, f"q long, {key} long, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), key)
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def upserted(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Stored documents (id, title, content, lang, embedding) after entries (id, title, content, lang): those of a known id
    take the new words, and keep their vector only while the content is the same; others are added without one. Of
    entries that share an id the last in order of content counts. Documents that no entry names stay."""
    new = entries.groupBy("id").agg(F.max(F.struct("content", "title", "lang")).alias("e"))
    both = stored.join(new, "id", "full")
    same = F.sha2("content", 256) == F.sha2("e.content", 256)
    pick = lambda c: F.when(F.col("e").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("id", pick("title"), pick("content"), pick("lang"), F.when(F.col("e").isNull() | same, F.col("embedding")).alias("embedding"))
