"""Near-duplicate join on word shingles: MinHash LSH forest for candidates, exact Jaccard for every link.

1. Each text becomes the set of its shingles; equal sets form one class with a representative.
2. Classes are looked up in the prefix tries of an LSH forest (lsh_forest.py), prefixes shortened until the target recall.
3. Classes linked there, directly or through others, are candidates for each other. Their sets are compared exactly, in
   blocks of bounded size, by products of sparse incidence matrices; blocks whose set sizes rule the threshold out are
   skipped. A block gives its classes' link counts and a spanning forest of its links, never pairs.
4. The forests' connected components are the near-duplicate classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, cut, join_counted, partitions, row_key
from .components import connected_components
from .lsh_forest import candidates
from .words import hashed, slices

_PRIME = 0x9E3779B97F4A7C15


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; a shorter text has one, of all its words."""
    h, counts = hashed(texts)
    powers = np.array([pow(_PRIME, j, 1 << 64) for j in range(size)], dtype=np.uint64)
    ends = np.cumsum(counts)
    out = []
    whole = np.full(max(0, len(h) - size + 1), size, dtype=np.uint64)
    for j in range(size):
        whole += h[j : j + len(whole)] * powers[j]
    for end, n in zip(ends.tolist(), counts.tolist()):
        s = whole[end - n : end - size + 1] if n >= size else (np.uint64(n) + h[end - n : end] * powers[:n]).sum(keepdims=True, dtype=np.uint64)[: min(n, 1)]
        s = s ^ (s >> np.uint64(32))
        s = s * np.uint64(0xD6E8FEB86659FD93)
        out.append(np.unique(s ^ (s >> np.uint64(32))))
    return out


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each hash function a*x+b over the set, as 32 bits; long sets go through in pieces."""
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(shingles), 4096):
        x = shingles[i : i + 4096]
        least = np.minimum(least, ((a[:, None] * x[None, :] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return least


def _signed(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """doc_id, doc, row, key (128-bit digest of the shingle set; null if empty), signature (of trees x depth MinHashes
    the low two bytes each) and n, the number of shingles."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            keys, signatures, counts = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                counts.append(len(s))
                keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                signatures.append(minhashes(s, a, b).astype(np.uint16).tobytes() if len(s) else None)
            columns = [*(batch.column(c) for c in ("doc_id", *ROW)), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *ROW, "key", "signature", "n"])

    return docs.select("doc_id", *row_key(), "text").mapInArrow(run, "doc_id long, doc long, row long, key binary, signature binary, n long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(blocks, sid, copies, text) to (blocks, sid, copies, shingles). A block has a name, a side, and whether it is a chunk's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = pa.array([s.tobytes() for s in shingle_sets(b.column("text"), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("blocks"), b.column("sid"), b.column("copies"), sets], ["blocks", "sid", "copies", "shingles"])

    return docs.mapInArrow(run, "blocks array<struct<block:string,side:int,own:boolean>>, sid long, copies long, shingles binary")


def compare(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity, as a matrix. Exact: intersections are counted."""
    sides = [left, right]
    sizes = [np.array([len(s) for s in side]) for side in sides]
    values = np.concatenate([*left, *right])
    owner = np.concatenate([np.repeat(np.arange(len(side)), n) for side, n in zip(sides, sizes)])
    on_right = np.arange(len(values)) >= sizes[0].sum()
    order = np.argsort(values, kind="stable")
    values, owner, on_right = values[order], owner[order], on_right[order]
    number = np.cumsum(np.concatenate(([True], values[1:] != values[:-1]))) - 1
    n = int(number[-1]) + 1
    both = (np.bincount(number[~on_right], minlength=n) > 0) & (np.bincount(number[on_right], minlength=n) > 0)
    new = np.cumsum(both) - 1
    keep = both[number]
    number, owner, on_right = new[number[keep]], owner[keep], on_right[keep]
    shared = np.zeros((len(left), len(right)), dtype=np.int64)
    for lo in range(0, int(both.sum()), 2048):
        begin, end = np.searchsorted(number, (lo, lo + 2048))
        x = np.zeros((len(left), 2048), dtype=np.float32)
        y = np.zeros((len(right), 2048), dtype=np.float32)
        part, who, r = number[begin:end] - lo, owner[begin:end], on_right[begin:end]
        x[who[~r], part[~r]] = 1
        y[who[r], part[r]] = 1
        shared += (x @ y.T).astype(np.int64)
    total = sizes[0][:, None] + sizes[1][None, :]
    s = Fraction(similarity).limit_denominator(1_000_000)
    return shared * (s.denominator + s.numerator) >= total * s.numerator  # shared / (total - shared) >= similarity, in integers


def _linked(blocks: DataFrame, similarity: float) -> DataFrame:
    """sid, links (documents linked, outside its class), root: for each class of each block. In an own block all classes
    are compared with each other, in others those of one side with those of the other, which may be empty."""

    def one(owns: list[bool], sides: list[int], ids: list[int], copies: list[int], sets: list[bytes]) -> tuple[list[int], list[int], list[int]]:
        arrays = [np.frombuffer(s, dtype=np.uint64) for s in sets]
        left = [i for i, s in enumerate(sides) if s == 0]
        right = [i for i, s in enumerate(sides) if s == 1]
        own = owns[0]
        right = left if own else right
        if not left or not right or own and len(left) < 2:
            return ids, [0] * len(ids), ids
        m = compare([arrays[i] for i in left], [arrays[i] for i in right], similarity)
        if own:
            np.fill_diagonal(m, False)
        weight = np.array(copies, dtype=np.int64)
        links = np.zeros(len(ids), dtype=np.int64)
        links[left] += m @ weight[right]
        if not own:
            links[right] += weight[left] @ m
        # each class's root: the least id that it reaches over the block's links
        label = np.array(ids, dtype=np.int64)
        a, b = label[left], label[right]
        big = np.iinfo(np.int64).max
        while True:
            low_a = np.minimum(a, np.where(m, b[None, :], big).min(axis=1))
            if own:
                low_a = np.minimum(low_a, np.where(m, a[:, None], big).min(axis=0))
                low_b = low_a
            else:
                low_b = np.minimum(b, np.where(m, low_a[:, None], big).min(axis=0))
            if (low_a == a).all() and (low_b == b).all():
                break
            a, b = low_a, low_b
        label[left], label[right] = a, b
        return ids, links.tolist(), label.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [], [])
        out: tuple[list[int], list[int], list[int]] = ([], [], [])

        def record() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["sid", "links", "root"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "own", "side", "sid", "copies", "shingles")]
            for k, *row in zip(*columns):
                if k != key:
                    if key is not None:
                        for c, more in zip(out, one(*held)):
                            c.extend(more)
                        if len(out[0]) > 10_000:
                            yield record()
                    key, held = k, ([], [], [], [], [])
                for c, x in zip(held, row):
                    c.append(x)
        if key is not None:
            for c, more in zip(out, one(*held)):
                c.extend(more)
        yield record()

    return blocks.mapInArrow(run, "sid long, links long, root long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.999, trees: int = 16, depth: int = 6, shortest: int = 2, crowd: int = 32, block: int = 128, most: int = 4096, shingles: int = 1_000_000
) -> DataFrame:
    """docs (doc_id, text) to doc_id, class_id (least doc_id of its near-duplicate class) and n_links.

    Two documents are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is at least
    ``similarity``; n_links counts the other documents that one is linked to, copies included. Words are those between
    ASCII white space, unchanged. A text of fewer words than a shingle has one shingle, all its words. Null and blank
    texts have no shingles: each is a class of its own without links. Rows with equal doc_id and text count as two
    documents. A null doc_id is the greatest as a class_id. Shingles are known by 64-bit hashes, sets by 128-bit ones.
    The result has one row for each row of docs; other columns play no part.

    ``recall`` is the least probability of a link at the threshold to be found. A block holds at most ``shingles``
    shingles or one text a side, and ``block`` classes a side, or a 32nd of its set sizes' classes up to ``most``.
    """
    spark = docs.sparkSession
    signed = cut(_signed(docs, shingle, trees, depth))
    classes = signed.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct(*ROW)).alias("text_of"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("n").alias("n")
    )
    classes = cut(classes.select("key", "doc_id", "text_of", F.monotonically_increasing_id().alias("sid"), "copies", "signature", "n"))
    groups = connected_components(candidates(classes.select("sid", "signature", "n"), similarity, recall, trees, depth, shortest, crowd))

    # Levels part a group by set size, so that sets within the similarity are of one level or of neighbouring ones.
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity))).cast("int")
    members = cut(groups.withColumnRenamed("u", "sid").join(classes.select("sid", "text_of", "copies", "n"), "sid").withColumn("level", level))
    fair = F.greatest(F.lit(float(block)), F.least(F.col("n") / 32, F.lit(float(most))))
    share = F.greatest(F.col("n") / fair, F.col("all") / shingles)  # of what a block may hold
    by_level = cut(members.groupBy("label", "level").agg(F.count("*").alias("n"), F.sum("n").alias("all")))
    sizes = by_level.groupBy("label").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).select("label", share.alias("size"))
    levels = by_level.join(sizes, "label").withColumn("chunks", F.ceil(share).cast("int"))
    near = lambda step, name: by_level.select("label", (F.col("level") - step).alias("level"), F.ceil(share).cast("int").alias(name))
    levels = cut(levels.join(near(-1, "below"), ["label", "level"], "left").join(near(1, "above"), ["label", "level"], "left").drop("all"))
    held = join_counted(members.withColumnRenamed("n", "shingles"), levels, ["label", "level"])
    small = held.filter("size <= 1")
    small = small.select("sid", "text_of", "copies", F.array(F.struct(F.col("label").cast("string").alias("block"), F.lit(0).alias("side"), F.lit(True).alias("own"))).alias("blocks"))
    large = held.filter("size > 1")
    large = large.withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))

    def name(low_level, low, high):
        return F.concat_ws(":", "label", low_level, low, high).alias("block")

    chunks = lambda c: F.sequence(F.lit(0), F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)) - 1)
    same = F.transform(
        chunks(F.col("chunks")),
        lambda j: F.struct(
            name(F.col("level"), F.least(j, F.col("chunk")), F.concat_ws("=", F.greatest(j, F.col("chunk")))), F.when(F.col("chunk") <= j, 0).otherwise(1).alias("side"), (F.col("chunk") == j).alias("own")
        ),
    )
    nothing = F.array_repeat(F.struct(F.lit("").alias("block"), F.lit(0).alias("side"), F.lit(False).alias("own")), 0)
    up = F.when(F.col("above").isNull(), nothing).otherwise(
        F.transform(chunks(F.col("above")), lambda j: F.struct(name(F.col("level"), F.col("chunk"), F.concat(F.lit("+"), j.cast("string"))), F.lit(0).alias("side"), F.lit(False).alias("own")))
    )
    down = F.when(F.col("below").isNull(), nothing).otherwise(
        F.transform(chunks(F.col("below")), lambda j: F.struct(name(F.col("level") - 1, j, F.concat(F.lit("+"), F.col("chunk").cast("string"))), F.lit(1).alias("side"), F.lit(False).alias("own")))
    )
    large = large.select("sid", "text_of", "copies", F.concat(same, up, down).alias("blocks"))
    placed = cut(small.unionByName(large).select("sid", "text_of.*", "copies", "blocks"))
    texts = docs.select(*row_key(), "text")
    with_text = placed.join(texts, ROW).dropDuplicates(["sid"]).select("blocks", "sid", "copies", "text")
    rows = _sets(with_text, shingle).select(F.explode("blocks").alias("b"), "sid", "copies", "shingles")
    rows = rows.select("b.block", "b.own", "b.side", "sid", "copies", "shingles").repartition(partitions(spark), "block").sortWithinPartitions("block")
    linked = cut(_linked(rows, similarity))
    counts = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    final = connected_components(linked.filter("sid != root").select(F.col("sid").alias("u"), F.col("root").alias("v")))
    own = classes.select("key", "sid", "doc_id", "copies").join(final.withColumnRenamed("u", "sid"), "sid", "left")
    own = own.withColumn("label", F.coalesce("label", "sid"))
    least = own.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    known = cut(own.join(cut(least), "label").join(counts, "sid", "left").select("key", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    keyed = signed.filter("key is not null").select("doc_id", "key")
    joined = join_counted(keyed, known, ["key"], "copies").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"))
    bare = signed.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(bare)
