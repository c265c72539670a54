"""Splitting text into the matches of a tokenizer's pattern, with a bounded cache of what each match encodes to.

Every match of the pattern is encoded by itself, and text repeats its words, so a task looks most matches up and encodes
only the new ones, many at a time. Nothing depends on other rows, so this needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import public_tokenizers
import regex

#: Characters of text handled at once.
SLICE_CHARS = 4_000_000

#: For texts of printable ASCII, tab, line ends and Latin letters alone, the standard library's faster engine finds the
#: same matches with its own classes: there a word character is a letter, a digit or the low line, and a number is a digit.
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]").search
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


class CachedEncoder:
    """texts -> for each, its ids as little-endian uint32 bytes.

    ``encode_words`` gets distinct pattern matches that are not cached and returns the bytes of each. The cache has two
    generations of about ``max_entries`` at most, which bounds a worker's memory: when the younger is full it becomes
    the older, and what is met again comes back from there. ``added`` are tokens that are found in texts before the
    pattern is applied, with the bytes of their ids.
    """

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[bytes]], max_entries: int = 200_000, added: dict[str, bytes] | None = None):
        full = regex.compile(pattern).findall
        self.findall = (lambda t: full(t) if _OTHER(t) else _PLAIN(t)) if pattern == public_tokenizers.PATTERN else full
        self.encode_words, self.max_entries, self.added = encode_words, max_entries, added or {}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The text's added tokens, each whole, and the pattern's matches in what lies between them."""
        if not any(a in text for a in self.added):
            return self.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.parts(text)):
            out += [part] if i % 2 else self.findall(part)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        begin = chars = 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= SLICE_CHARS or i + 1 == len(texts):
                yield from self._slice(texts[begin : i + 1])
                begin, chars = i + 1, 0

    def _slice(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(text or "") for text in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        missing = list(new.difference(self.words))
        known = [w for w in missing if w in self.older]
        self.words.update(zip(known, map(self.older.__getitem__, known)))
        missing = list(set(missing).difference(known)) if known else missing
        if missing:
            self.words.update(zip(missing, self.encode_words(missing)))
            self.words.update(self.added)
        get = self.words.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(self.words) > self.max_entries:
            self.words, self.older = {}, self.words
        return out
