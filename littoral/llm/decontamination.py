"""Benchmark decontamination by winnowing.

Of every ``width`` consecutive words the run of ``gram`` words with the least hash is a fingerprint, so a document that
shares so many consecutive words with a benchmark item shares a fingerprint with it. Fingerprints of both sides are
joined; each hit is then extended both ways over the windows that chose it, and stays where one equals a window of an
item. Items of fewer words are one window each, with fingerprints for windows of their own length.

Documents give their fingerprints in one pass without a shuffle, of which those go on that pass a bitmap of the
benchmark's (at most 2**27 bits, whatever its size): a clean corpus shuffles next to nothing. No text leaves that pass.
Words are told apart by 64-bit hashes, windows by 128 bits of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, cut, join_counted, row_key
from .words import hashed, slices

#: Upper case to lower case; all ASCII but letters and digits to a space; bytes of other characters stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
WINDOW = "start int, a long, b long"
PRINT = f"width int, fingerprint long, at int, windows array<struct<{WINDOW}>>"


def normal(texts: pa.Array) -> pa.Array:
    """Lower-case ASCII letters, digits and characters beyond ASCII stay, all else becomes spaces."""
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return pa.array([""] * len(texts), pa.string())
    edges = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = data.slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes().translate(_LOWER)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((edges - edges[0]).tobytes()), pa.py_buffer(plain)])


def _sums(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of every n consecutive word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(base)
        out += h[j : j + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _slide(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best of every n consecutive values, by spans of doubling length and then two that overlap."""
    step = 1
    while step * 2 <= n:
        values = best(values[:-step], values[step:])
        step *= 2
    return best(values[: len(values) - (n - step)], values[n - step :]) if n > step else values


def fingerprints(h: np.ndarray, counts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all fingerprints, those hashes, and the place of every window's first word that lies in one text."""
    gram = min(gram, width)
    span = width - gram + 1
    if len(h) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    grams = _sums(h, gram, _BASES[0] + 2 * width)
    low = _slide(grams, span, np.minimum)
    ends = np.repeat(np.cumsum(counts), counts)[: len(low)]
    inside = np.arange(width, width + len(low)) <= ends
    edge = np.zeros(span - 1, dtype=np.uint64)
    high = _slide(np.concatenate((edge, np.where(inside, low, np.uint64(0)), edge)), span, np.maximum)
    at = np.flatnonzero(high == grams)
    return at, grams[at], np.flatnonzero(inside)


def prints(texts: pa.Array, widths: list[int], gram: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and its fingerprints as a list of PRINT."""
    h, counts = hashed(normal(texts))
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    found = []
    for width in widths:
        at, key, windows = fingerprints(h, counts, width, gram)
        if bitmap is not None:
            bits = (len(bitmap) * 64).bit_length() - 1
            known = np.ones(len(key), dtype=bool)
            for bit in (key >> np.uint64(64 - bits), key & np.uint64((1 << bits) - 1)):
                known &= (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            at, key = at[known], key[known]
        lo = np.searchsorted(windows, np.maximum(at - width + min(gram, width), first[doc[at]]))  # windows about each fingerprint
        n = np.searchsorted(windows, at, side="right") - lo
        inner = windows[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        found.append((at, key, np.full(len(at), width), n, inner, *(_digests(h, inner, width, base) for base in _BASES)))
    none = np.zeros(0, dtype=np.int64)
    at, key, width, n, inner, a, b = (np.concatenate(x) for x in zip((none, none.view(np.uint64), *[none] * 5), *found))
    order = np.argsort(doc[at], kind="stable")
    moved = np.repeat((np.cumsum(n) - n)[order] - (np.cumsum(n[order]) - n[order]), n[order]) + np.arange(n.sum())
    inner, a, b = inner[moved], a[moved], b[moved]
    at, key, width, n = at[order], key[order], width[order], n[order]
    local = lambda x: pa.array((x - first[doc[x]]).astype(np.int32))
    lists = lambda sizes, items: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), items)
    windows = lists(n, pa.StructArray.from_arrays([local(inner), pa.array(a), pa.array(b)], ["start", "a", "b"]))
    rows = pa.StructArray.from_arrays([pa.array(width.astype(np.int32)), pa.array(key.view(np.int64)), local(at), windows], ["width", "fingerprint", "at", "windows"])
    return counts, lists(np.bincount(doc[at], minlength=len(counts)), rows)


def _digests(h: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    out = np.full(len(starts), width, dtype=np.uint64)
    for j in range(width):
        out *= np.uint64(base)
        out += h[starts + j]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _printed(rows: DataFrame, widths: list[int], gram: int, bitmap=None) -> DataFrame:
    """rows (keys, text) to keys, n_words and prints."""
    names = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for whole in batches:
            for b in slices(whole, at_most=4_000_000):
                counts, found = prints(b.column("text"), widths, gram, bits)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(counts.astype(np.int64)), found], [*names, "n_words", "prints"])

    return rows.mapInArrow(run, f"{fields}, n_words long, prints array<struct<{PRINT}>>")


def _windows(printed: DataFrame, *keys: str) -> DataFrame:
    rows = printed.select(*keys, F.explode("prints").alias("p"))
    return rows.select(*keys, "p.width", "p.fingerprint", "p.windows")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Two bits for each fingerprint, by its first and its last bits, among some 256 for each and 2**27 at most."""
    bits = min(27, max(16, (256 * prints.count()).bit_length()))
    ends = F.array(F.shiftrightunsigned("fingerprint", 64 - bits), F.col("fingerprint").bitwiseAND(F.lit((1 << bits) - 1)))
    bit = prints.select(F.explode(ends).alias("bit"))
    rows = bit.select(F.shiftright("bit", 6).alias("k"), F.pmod("bit", F.lit(64)).cast("int").alias("at"))
    words = rows.groupBy("k").agg(F.expr("bit_or(shiftleft(1L, at))").alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["k"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _set_of(*members: str) -> list[Column]:
    """What tells sets of distinct rows apart, in sums that Spark combines map-side: 128 bits and the number of rows."""
    return [*(F.expr(f"bit_xor(xxhash64({k}, {', '.join(members)}))").alias(f"set_{k}") for k in (0, 1)), F.count("*").alias("set_n")]


_SET = ["set_0", "set_1", "set_n"]
_PLACE = ["width", "a", "b"]


def _joined(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is in ``other``, which has each key once; keys that many rows hold are met by broadcast."""
    stats = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).join(other, key))
    return join_counted(rows, stats, key).drop("n")


def benchmark_windows(benchmark: DataFrame, width: int, gram: int) -> tuple[DataFrame, list[int]]:
    """width, fingerprint, a, b, item: every window of the items, each once; and the windows' lengths (``width`` at most)."""
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    lengths = _printed(items, [], gram).select(F.least("n_words", F.lit(width)).alias("n")).filter("n > 0").distinct()
    widths = sorted(r["n"] for r in lengths.collect())
    rows = _windows(_printed(items, widths, gram), "item", "n_words").filter(F.col("width") == F.least("n_words", F.lit(width)))
    rows = rows.select("item", "width", "fingerprint", F.explode("windows").alias("w")).select("item", "width", "fingerprint", "w.a", "w.b")
    return cut(rows.distinct()), widths


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, gram: int = 5) -> DataFrame:
    """docs (doc_id, text, any others) without their text, and n_words, n_hit, spans and items.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. A window is ``width``
    consecutive words of an item of ``benchmark`` (item_id, text); an item of fewer words, but not none, is one window.
    A document's word is hit if it lies in any occurrence of a window. ``spans`` are the longest stretches (start, stop)
    of hit words, ``n_hit`` their number of words, ``items`` the ids of the items with windows there, sorted as strings.
    Null and empty texts have no words; items without id or words take no part; equal ids count once. Rows equal in
    doc_id and text get equal results; documents of any length are judged whole. Without hits, or with an empty
    benchmark, spans and items are empty. Columns of the added names, doc, row and prints are replaced.

    A passage in many documents or items makes hot fingerprints and windows; those meet by broadcast. Items are looked
    up once for each distinct set of them, so many documents that hold the same passage share one list.
    """
    added = ["n_words", "n_hit", "spans", "items"]
    docs = docs.drop(*added, *ROW, "prints")
    windows, widths = benchmark_windows(benchmark, width, gram)
    known = cut(windows.select("width", "fingerprint").distinct())
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(known))
    rows = docs.select(*(c for c in docs.columns if c != "text"), *row_key(), "text")
    printed = cut(_printed(rows, widths, gram, bitmap))
    once = printed.filter(F.size("prints") > 0).select(*ROW, "prints").dropDuplicates(ROW)
    hits = _joined(cut(_windows(once, *ROW)), known, ["width", "fingerprint"])
    about = cut(hits.select(*ROW, "width", F.explode("windows").alias("w")).select(*ROW, "width", "w.start", "w.a", "w.b").distinct())
    holders = cut(windows.select(*_PLACE, "item").distinct().groupBy(*_PLACE).agg(*_set_of("item")))
    found = cut(_joined(about, holders, _PLACE).select(*ROW, "start", (F.col("start") + F.col("width")).alias("stop"), *_SET))

    before = Window.partitionBy(*ROW).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = found.select(*ROW, "start", "stop", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int").alias("fresh"))
    stretch = fresh.withColumn("stretch", F.sum("fresh").over(Window.partitionBy(*ROW).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    stretches = stretch.groupBy(*ROW, "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = stretches.groupBy(*ROW).agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    classes = cut(found.select(*ROW, *_SET).distinct())
    sets = cut(classes.groupBy(*ROW).agg(*_set_of(*_SET)))
    one = sets.groupBy(*_SET).agg(F.min(F.struct(*ROW)).alias("at")).select(*(F.col(c).alias(f"of_{c}") for c in _SET), *(f"at.{c}" for c in ROW))
    held = _joined(windows.select(*_PLACE, "item").distinct(), holders, _PLACE).select(*_SET, "item").distinct()
    lists = one.join(classes, ROW).join(held, _SET).groupBy(*(F.col(f"of_{c}").alias(c) for c in _SET)).agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = spans.join(_joined(sets, lists, _SET).select(*ROW, "items"), ROW)

    out = printed.drop("prints").join(result, ROW, "left")
    none = F.array()
    return out.select(
        *(c for c in docs.columns if c != "text"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", none).alias("items"),
    )
