"""The trie of conversations by prefix-doubling naming.

Blocks of one turn get dense names, equal for equal turns; a block of twice the length is a pair of names, and such pairs
get dense names again, so the rounds grow with the logarithm of the longest conversation. The first d turns are then told
by at most log d block names, those of d's binary decomposition, and equal ones make up a node.

Names are ranks in a range-partitioned sort in which the conversation breaks ties, so a turn that a third of all
conversations share is cut over many tasks. Sums over subtrees double the distance to an ancestor in each round. No round
holds more than a row or so for each turn, and only a row for each partition reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_shuffles, join_counted, partitions

_RANKS = [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("name", T.LongType())]


def ranked(rows: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """Adds place, the row's number in the order of key and ties, and name, the number of lesser keys. Keys aren't null."""
    schema = T.StructType([*rows.schema, *_RANKS])
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, name, last = TaskContext.get().partitionId(), 0, -1, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for c in map(b.column, key):
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last != (first := [b.column(c)[0].as_py() for c in key])
            last = first if n == 1 else [b.column(c)[n - 1].as_py() for c in key]
            names = name + np.cumsum(new)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(place, place + n)), pa.array(names)], schema.names)
            place, name = place + n, int(names[-1])

    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *key, *ties).sortWithinPartitions(*key, *ties)
    local = cut(ordered.mapInArrow(run, schema))
    ends = [f(F.struct(*key), "place").alias(c) for f, c in ((F.min_by, "first"), (F.max_by, "last"))]
    parts = local.groupBy("part").agg(F.count("*").alias("n"), F.max("name").alias("top"), *ends).collect()
    size = 1 + max((p["part"] for p in parts), default=0)
    places, names = [0] * size, [0] * size
    place = name = 0
    last = None
    for p in sorted(parts, key=lambda p: p["part"]):
        name -= p["first"] == last  # a key goes on from the part before
        places[p["part"]], names[p["part"]] = place, name
        place, name, last = place + p["n"], name + p["top"] + 1, p["last"]
    shift = lambda x: F.element_at(F.lit(x), F.col("part") + 1).cast("long")
    return local.withColumns({"place": F.col("place") + shift(places), "name": F.col("name") + shift(names)}).drop("part")


def number_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations (conv_id, turn, role, text): conv_id, at (from 0), key and size; and the conversations:
    conv_id and n, their number of turns.

    Order is by turn (nulls first), then role, then a hash of role and text. Null role and text are empty. ``key`` tells
    role and text by 256 bits, ``size`` is the text's code points. Rows without conv_id are in no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.char_length(text).cast("long").alias("size"))
    placed = ranked(turns.withColumn("source", F.spark_partition_id()), ["conv_id"], ["turn", "role", "key", "source"])
    convs = cut(placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    rows = join_counted(placed, convs, ["conv_id"]).select("conv_id", (F.col("place") - F.col("first")).alias("at"), "key", "size")
    return cut(rows), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, prefix, size: for each turn the prefix that ends with it, equal for equal sequences of turns, and the turn's size."""
    blocks = ranked(turns.select("conv_id", "at", "key"), ["key"], ["conv_id", "at"]).select("conv_id", F.col("at").alias("k"), "name")
    longest = turns.agg(F.max("at")).first()[0]
    parts = turns.select("conv_id", (F.col("at") + 1).alias("depth"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("name"), "size")
    level = 0
    while longest is not None:
        ends = F.sequence((F.col("k") * (1 << level)) + (1 << level), (F.col("k") + 2) * (1 << level) - 1)
        ending = blocks.filter("k % 2 = 0").select("conv_id", F.explode(ends).alias("depth"), F.lit(level).alias("level"), "name", F.lit(None).cast("long").alias("size"))
        parts = parts.unionByName(ending.filter(F.col("depth") <= longest + 1))
        level += 1
        if longest + 1 < 1 << level:
            break
        half = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.col("name")))
        pairs = blocks.groupBy("conv_id", F.floor(F.col("k") / 2).alias("k")).agg(half(0).alias("l"), half(1).alias("r")).filter("l IS NOT NULL AND r IS NOT NULL")
        blocks = ranked(pairs, ["l", "r"], ["conv_id", "k"]).select("conv_id", "k", "name")
    named = F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "name"))))
    whole = parts.groupBy("conv_id", "depth").agg(named.alias("names"), F.max("size").alias("size")).filter("size IS NOT NULL")
    prefix = F.concat_ws(",", F.col("depth").cast("string"), F.transform("names", lambda x: x["name"].cast("string")))
    return cut(whole.select("conv_id", "depth", prefix.alias("prefix"), "size"))


def _ends(ending: DataFrame) -> DataFrame:
    """node, conv_id to node, ends_sha256: ids joined piece by piece where they are sorted, then the pieces of a
    node in their order hashed one after another."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            node, ids = b.column("node").to_pylist(), b.column("conv_id").to_pylist()
            new = [0, *(k for k in range(1, len(ids)) if node[k] != node[k - 1]), len(ids)]
            out = []
            for lo, hi in zip(new, new[1:]):
                if hi > lo:
                    piece = ",".join(map(str, ids[lo:hi]))
                    if held and held[0] == node[lo] and len(held[2]) < 1_000_000:
                        held = (*held[:2], f"{held[2]},{piece}")
                    else:
                        out += [held] if held else []
                        held = node[lo], ids[lo], piece
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.int64(), pa.string()))], ["node", "first", "piece"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([held[2]])], ["node", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            out = []
            for node, piece in zip(b.column("node").to_pylist(), b.column("piece").to_pylist()):
                if sha and node == last:
                    sha.update(b"," + piece.encode())
                else:
                    out += [(last, sha.hexdigest())] if sha else []
                    last, sha = node, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    n = partitions(ending.sparkSession)
    ordered = ending.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ordered.mapInArrow(join, "node string, first long, piece string")
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digest, "node string, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, owners: DataFrame, root: int, deepest: int, columns: list[str]) -> DataFrame:
    """nodes (conv_id, depth, columns) to the columns summed over each subtree.

    In round j a node knows the sums down to less than 2**j levels below it, and gives them to its ancestor 2**j above:
    the node at that depth of its own smallest member, whose owner is looked up. A node of one conversation that is many
    turns deep takes part in logarithmically many rounds.
    """
    total = [F.sum(c).alias(c) for c in columns]
    sums, step = nodes, 1
    while step <= deepest:
        live = sums.filter(F.col("depth") >= step).groupBy("conv_id", "depth").agg(*total).withColumn("depth", F.col("depth") - step)
        met = live.join(owners, ["conv_id", "depth"], "left").select(F.coalesce("owner", F.lit(root)).alias("conv_id"), "depth", *columns)
        sums = sums.unionByName(cut(met.groupBy("conv_id", "depth").agg(*total)))
        step *= 2
    return sums.groupBy("conv_id", "depth").agg(*total)


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, at, key, size, as ``number_turns`` gives them) and ``convs`` (conv_id, each once).

    A node is a distinct sequence of a conversation's first turns; its members are the conversations that start with it.
    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree, itself included), saved_tokens (over the subtree: (n_convs - 1) * size of
    the node's last turn) and ends_sha256 (of the members without further turns: ids ascending, joined by commas).
    Conversations without turns are members of the root alone. Without conversations there are no nodes.
    """
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = top.first()["conv_id"]
    rows = prefixes(turns)
    free_shuffles(turns.sparkSession)
    grouped = cut(rows.groupBy("prefix", "depth").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.max("size").alias("size")))
    owners = cut(join_counted(rows.select("conv_id", "depth", "prefix"), grouped.select("prefix", "owner", "n"), ["prefix"]).select("conv_id", "depth", "owner"))
    deepest = grouped.agg(F.max("depth")).first()[0] or 0
    nodes = grouped.select(F.col("owner").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "size")
    above = owners.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    linked = nodes.join(above, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(root)))
    first = top.filter("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("parent_conv_id"))
    linked = cut(linked.unionByName(first))
    children = linked.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    full = cut(linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = full.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    sums = _subtree_sums(own, owners, root, deepest, ["n_leaves", "saved_tokens"])
    last = owners.groupBy("conv_id").agg(F.max_by(F.struct("owner", "depth"), "depth").alias("last"))
    node = lambda owner, depth: F.concat_ws(",", depth.cast("string"), owner.cast("string")).alias("node")
    ends = _ends(convs.join(last, "conv_id", "left").select(node(F.coalesce("last.owner", F.lit(root)), F.coalesce("last.depth", F.lit(0))), "conv_id"))
    out = full.join(sums, ["conv_id", "depth"]).withColumn("node", node(F.col("conv_id"), F.col("depth"))).join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
