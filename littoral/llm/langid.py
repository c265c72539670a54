"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word's likelihood is the sum, over all ways to cut
it into pieces, of the product of the pieces' probabilities; a forward pass over the word adds them up. The same pass,
with its backward counterpart, gives the expected piece counts from which the probabilities are learnt (EM).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, draw

#: UNKNOWN is the probability of a character that is no piece. A word of more than SHORT letters is summed in logarithms,
#: since products of so many probabilities leave a double's range.
SHORT, UNKNOWN, FLOOR = 30, 1e-8, 1e-8
WORD_START = "▁"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold(codes: np.ndarray, length: int, previous: np.ndarray | None) -> np.ndarray:
    """Hashes of all substrings of this length (rows: words of equal length), from those one shorter."""
    width = codes.shape[1] - length + 1
    tail = codes[:, length - 1 :]
    return tail + np.uint64(1) if previous is None else previous[:, :width] * _BASE + tail + np.uint64(1)


class Pieces:
    """The vocabulary: finds the number of the piece at each place of many words at once; number ``n`` is no piece."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.pieces = sorted(set(found))
        self.n, self.longest = len(self.pieces), max(map(len, self.pieces))
        hashes = np.zeros(self.n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i, piece in enumerate(self.pieces):
                h = None
                row = np.array([[ord(c) for c in piece]], dtype=np.uint64)
                for length in range(1, len(piece) + 1):
                    h = _fold(row, length, h)
                hashes[i] = h[0, 0]
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.seen = np.zeros(1 << 20, dtype=bool)  # by the hash's upper bits: most substrings are no piece and end here
        self.seen[hashes >> np.uint64(44)] = True
        assert len(np.unique(hashes)) == self.n

    def spans(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length from 1: the piece's number at each start."""
        out, h = [], None
        with np.errstate(over="ignore"):
            for length in range(1, min(self.longest, codes.shape[1]) + 1):
                h = _fold(codes, length, h)
                numbers = np.full(h.shape, self.n)
                maybe = self.seen[h >> np.uint64(44)]
                some = h[maybe]
                at = np.minimum(np.searchsorted(self.sorted, some), self.n - 1)
                numbers[maybe] = np.where(self.sorted[at] == some, self.order[at], self.n)
                out.append(numbers)
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their places and their code points, the word-start mark first."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        joined = "".join(WORD_START + words[i] for i in at)
        yield at, np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").reshape(len(at), n + 1).astype(np.uint64)


def _matches(spans: list[np.ndarray], n: int) -> list[list[tuple[int, np.ndarray | None, np.ndarray]]]:
    """For each start: (length, words, pieces) of the pieces that stand there in any word; words is None for all of them,
    as it is for single characters, which stand for themselves when they are no piece."""
    out: list[list[tuple[int, np.ndarray | None, np.ndarray]]] = []
    for t in range(spans[0].shape[1]):
        here = [(1, None, spans[0][:, t])]
        for length in range(2, len(spans) + 1):
            if t < spans[length - 1].shape[1]:
                numbers = spans[length - 1][:, t]
                words = np.flatnonzero(numbers < n)
                if len(words):
                    here.append((length, words, numbers[words]))
        out.append(here)
    return out


def forward(matches: list, p, logs: bool) -> list[np.ndarray]:
    """alpha[t]: summed probability of all segmentations of the first t characters, or its logarithm. p(words, numbers)
    is the pieces' probability (or logarithm) in those words."""
    first = p(None, matches[0][0][2])
    alpha = [np.full(first.shape, -np.inf if logs else 0.0) for _ in range(len(matches) + 1)]
    alpha[0][:] = 0.0 if logs else 1.0
    for t, here in enumerate(matches):
        for length, words, numbers in here:
            value, to = p(words, numbers), alpha[t + length]
            at = slice(None) if words is None else words
            to[at] = np.logaddexp(to[at], alpha[t][at] + value) if logs else to[at] + alpha[t][at] * value
    return alpha


def log_likelihoods(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log of the marginal probability of each word under each language."""
    plain = np.concatenate((table, np.full((1, table.shape[1]), UNKNOWN)))
    logs = np.log(plain)
    out = np.zeros((len(words), table.shape[1]))
    for at, codes in _by_length(words):
        long = codes.shape[1] > SHORT
        alpha = forward(_matches(pieces.spans(codes), pieces.n), lambda _, numbers: (logs if long else plain)[numbers], long)  # noqa: B023
        out[at] = alpha[-1] if long else np.log(alpha[-1])
    return out


def expected_counts(words: list[str], lang: np.ndarray, weight: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, each word under its own language and counted ``weight`` times."""
    k = table.shape[1]
    plain = np.concatenate((table, np.full((1, k), UNKNOWN))).ravel()
    logs = np.log(plain)
    index, used = [], []
    for at, codes in _by_length(words):
        matches, own, n, long = _matches(pieces.spans(codes), pieces.n), lang[at], weight[at], codes.shape[1] > SHORT
        pick = lambda x, some: x if some is None else x[some]
        p = lambda some, numbers: (logs if long else plain)[numbers * k + pick(own, some)]  # noqa: B023, E731
        alpha = forward(matches, p, long)
        beta = [np.full(len(at), -np.inf if long else 0.0) for _ in range(len(matches) + 1)]
        beta[-1][:] = 0.0 if long else 1.0
        for t in range(len(matches) - 1, -1, -1):
            for length, some, numbers in matches[t]:
                here = slice(None) if some is None else some
                rest = beta[t + length][here] + p(some, numbers) if long else beta[t + length][here] * p(some, numbers)
                beta[t][here] = np.logaddexp(beta[t][here], rest) if long else beta[t][here] + rest
                share = np.exp(alpha[t][here] + rest - alpha[-1][here]) if long else alpha[t][here] * rest / alpha[-1][here]
                index.append(numbers * k + pick(own, some))
                used.append(share * pick(n, some))
    size = (pieces.n + 1) * k
    counts = np.bincount(np.concatenate(index), np.concatenate(used), size) if index else np.zeros(size)
    return counts.reshape(pieces.n + 1, k)[: pieces.n]


def runs(text: str) -> list[str]:
    """The words of a text: runs of letters with the marks on them, as they are written. Most chunks are one word."""
    bare = text.strip(".,;:!?\"'()")
    return [bare] if bare.isalpha() else _LETTERS.findall(bare)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # piece x language probabilities
    vocabulary: str


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def fit(labelled: DataFrame, vocabulary: str, per_lang: int = 2_000, rounds: int = 3, key: str = "doc_id") -> LanguageModel:
    """Learns from (key, text, lang); rows with a null text or lang are left out.

    At most about ``per_lang`` documents of each language are used, those with the lowest hash of ``key``: the bound of
    the sample. The driver gets only the vocabulary-sized tables of expected counts.
    """
    spark = labelled.sparkSession
    labelled = labelled.select(key, "text", "lang").filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((0, 0)), vocabulary)
    shares = spark.createDataFrame([(i, x, min(1.0, per_lang / sizes[x])) for i, x in enumerate(langs)], "i int, lang string, share double")
    sample = labelled.join(F.broadcast(shares), "lang").filter(draw("langid", key) < F.col("share"))
    words = sample.select("i", F.explode(F.split("text", r"[^\p{L}\p{M}]+")).alias("word")).filter("word != ''")
    words = cut(words.groupBy("i", "word").agg(F.count("*").alias("n")))
    n_pieces = _pieces(vocabulary).n
    table = np.full((n_pieces, len(langs)), 1 / n_pieces)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(table)

        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pieces, counts = _pieces(vocabulary), None
            for b in batches:
                rows = [(w, i, n) for word, i, n in zip(*(b.column(c).to_pylist() for c in ("word", "i", "n"))) for w in runs(word)]
                if rows:
                    w, i, n = zip(*rows)
                    more = expected_counts(list(w), np.array(i), np.array(n, dtype=float), pieces, held.value)
                    counts = more if counts is None else counts + more
            if counts is not None:
                piece, i = np.nonzero(counts > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(i), pa.array(counts[piece, i])], ["piece", "i", "n"])

        summed = words.mapInArrow(step, "piece long, i long, n double").groupBy("piece", "i").agg(F.sum("n").alias("n"))
        got = summed.toPandas()  # at most one row for each piece and language
        table = np.zeros((n_pieces, len(langs)))
        table[got["piece"].to_numpy(dtype=int), got["i"].to_numpy(dtype=int)] = got["n"]
        table = table / np.maximum(table.sum(axis=0), 1e-9) * (1 - FLOOR * n_pieces) + FLOOR
    return LanguageModel(langs, table, vocabulary)


class _Scorer:
    """Scores whole texts; what a space-delimited chunk adds is cached, up to max_entries chunks."""

    def __init__(self, model: LanguageModel, max_entries: int = 200_000):
        self.model, self.pieces, self.max_entries = model, _pieces(model.vocabulary), max_entries
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.values = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, dtype=bool)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        begin = chars = 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= 4_000_000 or i + 1 == len(texts):
                yield from self._slice([(t or "").split() for t in texts[begin : i + 1]])
                begin, chars = i + 1, 0

    def _slice(self, split: list[list[str]]) -> Iterator[tuple[str, float]]:
        new: set[str] = set()
        for chunks in split:
            new.update(chunks)
        self._add(list(new.difference(self.row)))
        get, langs = self.row.__getitem__, self.model.langs
        for chunks in split:
            rows = np.fromiter(map(get, chunks), dtype=np.int64, count=len(chunks))
            if not langs or not self.letters[rows].any():
                yield "und", 0.0
                continue
            total = self.values[rows].sum(axis=0)
            share = np.exp(total - total.max())
            yield langs[int(total.argmax())], float(share.max() / share.sum())
        if len(self.row) > self.max_entries:
            self._clear()

    def _add(self, chunks: list[str]) -> None:
        parts = [runs(c) for c in chunks]
        number: dict[str, int] = {}
        for words in parts:
            for w in words:
                number.setdefault(w, len(number))
        scores = log_likelihoods(list(number), self.pieces, self.model.table) if number and self.model.langs else np.zeros((len(number), len(self.model.langs)))
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        flat = scores[[number[w] for words in parts for w in words]] if number else np.zeros((0, scores.shape[1]))
        sums = np.zeros((len(chunks), scores.shape[1]))
        np.add.at(sums, np.repeat(np.arange(len(chunks)), counts), flat)
        base = len(self.row)
        self.row.update(zip(chunks, range(base, base + len(chunks))))
        self.values = np.concatenate((self.values, sums))
        self.letters = np.concatenate((self.letters, counts > 0))


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (the language's share of the posterior under equal priors) from the text alone.

    Null texts, texts without letters, and any text where nothing was learnt: ``und`` with score 0. Ties go to the
    language that sorts first. Columns of those names are replaced. No shuffle; rows are handled one by one.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(held.value)
        for batch in batches:
            got = list(scorer.texts(batch.column(text).to_pylist()))
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
