"""Best-fit packing of token pieces into fixed-size sequences, by hierarchical residual packing."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .pretoken import CachedEncoder

_ENCODERS: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> CachedEncoder:
    """The tokenizers library's ids: texts are split at the file's added tokens, which have ids of their own, then by the
    byte-level pattern, each match of which the library's BPE model encodes by itself."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        model, added = whole.model, whole.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that depend on what stands about them are not supported")
        ids_of = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        table = str.maketrans({chr(b): c for b, c in shown.items()})

        def encode_words(words: list[str]) -> list[bytes]:
            return [array("I", [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(table))]).tobytes() for w in words]

        _ENCODERS[path] = CachedEncoder(public_tokenizers.PATTERN, encode_words, added=ids_of)
    return _ENCODERS[path]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Documents (doc_id, text) to pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids.

    A document is its text's ids and then ``end_id``; null and empty texts are ``end_id`` alone. One longer than
    ``capacity`` is cut so that only its first piece is shorter. ``ids`` holds little-endian unsigned 32-bit ids. Rows
    with the same doc_id are cut each by itself. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            docs, rows = batch.column("doc_id").to_pylist(), []
            for doc, ids in zip(docs, encoder.encode(batch.column("text").to_pylist())):
                ids += end
                n, begin = len(ids) // 4, 0
                stop, piece = (n - 1) % capacity + 1, 0
                while begin < n:
                    rows.append((doc, piece, begin, stop - begin, ids[begin * 4 : stop * 4]))
                    begin, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            for k in range(0, len(rows), 20_000):
                columns = zip(*rows[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], PIECES.names)
        encoder.clear()  # workers live on for other stages, which need the memory
        pa.default_memory_pool().release_unused()

    return df.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the numbers of the items in each bin. Open bins are listed by residual; a bit set of the
    residuals in use finds the tightest fit in one step."""
    bins: list[list[int]] = []
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = used >> size
        if fits:
            residual = size + (fits & -fits).bit_length() - 1
            b = by_residual[residual].pop()
            if not by_residual[residual]:
                used &= ~(1 << residual)
            bins[b].append(item)
        else:
            residual, b = capacity, len(bins)
            bins.append([item])
        if residual > size:
            by_residual[residual - size].append(b)
            used |= 1 << residual - size
    return bins


def pack(items: DataFrame, capacity: int = 1024, per_task: int = 100_000, fan_in: int = 8) -> DataFrame:
    """Items (any columns, with ``length`` from 1 to ``capacity``) to sequences: adds sequence_id and offset.

    The items are checkpointed first: whatever made them isn't run beside the packing. Round 0 packs each partition's
    items best-fit where they lie. Bins that can't be joined with the emptiest bin of all are done; the others travel,
    with their contents, as items of the next round, in which ``fan_in`` partitions are packed as one. A round leaves at
    most one bin that isn't over half full for each ``per_task`` items, so the rounds end soon: when no two bins can be
    joined any more, or when as many partitions as before joined none. Each round is checkpointed, so that ids stay fixed when executors are lost. Equal items are items
    of their own. Columns named sequence_id and offset are replaced.
    """
    items = cut(items.drop("sequence_id", "offset"))
    fields = T.StructType([*(T.StructField(f.name, f.dataType) for f in items.schema), T.StructField("offset", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("fill", T.LongType()),
            T.StructField("contents", T.ArrayType(fields)),
        ]
    )
    single = F.struct(*items.columns, F.lit(0).cast("long").alias("offset"))
    bins = items.select(F.col("length").cast("long").alias("fill"), F.array(single).alias("contents"))

    def packed(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = level << 56 | TaskContext.get().partitionId() << 33
            waiting: list[pa.RecordBatch] = []
            for batch in batches:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) >= per_task:
                    yield emit(waiting, number)
                    number, waiting = number + (1 << 20), []
            if waiting:
                yield emit(waiting, number)

        def emit(waiting: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            groups = best_fit(table.column("fill").to_numpy(), capacity)
            order = np.array([i for g in groups for i in g], dtype=np.int64)
            contents = table.column("contents").combine_chunks()
            contents = contents.chunk(0) if isinstance(contents, pa.ChunkedArray) else contents
            counts = contents.value_lengths().to_numpy()[order]
            flat = contents.take(pa.array(order)).flatten()
            per_bin = np.add.reduceat(counts, np.concatenate(([0], np.cumsum([len(g) for g in groups])[:-1])))
            ends = np.cumsum(per_bin)
            lengths = flat.field("length").to_numpy().astype(np.int64)
            before = np.cumsum(lengths) - lengths
            offsets = before - np.repeat(before[ends - per_bin], per_bin)
            arrays = [flat.field(f.name) if f.name != "offset" else pa.array(offsets) for f in fields]
            column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.StructArray.from_arrays(arrays, fields.names))
            fill = np.add.reduceat(lengths, ends - per_bin)
            return pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(groups))), pa.array(fill), column], schema.names)

        return run

    result = cut(bins.mapInArrow(packed(0), schema))
    parts, level, done = max(1, result.rdd.getNumPartitions()), 0, []
    while True:
        least = [r.fill for r in result.orderBy("fill").select("fill").limit(2).collect()]
        if len(least) < 2 or sum(least) > capacity:
            break
        joinable = F.col("fill") <= capacity - least[0]
        done.append(result.filter(~joinable))
        rest = result.filter(joinable)
        left, before = rest.count(), parts
        parts, level = max(-(-parts // fan_in), -(-left // per_task)), level + 1
        result = cut(rest.select("fill", "contents").repartition(parts).mapInArrow(packed(level), schema))
        if parts == before and result.count() == left:
            break
    for d in done:
        result = result.unionByName(d)
    return result.select("sequence_id", F.inline("contents"))
