"""Words of whole texts, hashed a batch at a time. Words are what lies between ASCII white space, unchanged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def slices(batch: pa.RecordBatch, text: str = "text", at_most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``at_most`` bytes of text."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // at_most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one text after another, and the number of words of each text (null: none).

    Each distinct word is hashed once.
    """
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = split.flatten().dictionary_encode()
    distinct = flat.dictionary.cast(pa.binary()).to_pylist()
    codes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
    empty = np.fromiter((not w for w in distinct), dtype=bool, count=len(distinct))
    index = flat.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy())
    real = ~empty[index] if empty.any() else np.ones(len(index), dtype=bool)
    return codes[index][real], np.bincount(owner[real], minlength=len(texts))
