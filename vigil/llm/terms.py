"""Hashed terms of whole texts, for the classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np

_CACHE = 200_000
_RUNS = re.compile(r"(.)\1+", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


def shape(word: str) -> str:
    """Letters by case, digits as 0, other characters as they are; runs shortened to one."""
    out = []
    for c in word:
        out.append(("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c)
    return _RUNS.sub(r"\1", "".join(out))


def bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


class StyleTerms:
    """Word, shape, shape-pair and repetition terms, hashed to ``words + shapes + pairs + 8`` columns."""

    def __init__(self, words: int = 1024, shapes: int = 256, pairs: int = 512) -> None:
        self.words, self.shapes, self.pairs = words, shapes, pairs
        self.size = words + shapes + pairs + 8
        self._cache: dict[str, int] = {}

    def _code(self, word: str) -> int:
        """The word's bucket and its shape's, in one integer."""
        code = bucket(word.lower(), self.words) * self.shapes + bucket(shape(word), self.shapes)
        if len(self._cache) >= _CACHE:
            self._cache.clear()
        self._cache[word] = code
        return code

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The columns that occur, and how often."""
        words = text.split()
        if not words:
            return np.array([self.size - 8]), np.array([1])
        get = self._cache.get
        found = [get(w) for w in words]
        if None in found:
            found = [self._code(w) if c is None else c for w, c in zip(words, found, strict=True)]
        codes = np.array(found, np.int64)
        word, form = codes // self.shapes, codes % self.shapes
        pair = (form[:-1] * 31 + form[1:]) % self.pairs
        same = int((codes[1:] == codes[:-1]).sum())
        parts = [word, form + self.words, pair + self.words + self.shapes]
        tf = np.bincount(np.concatenate(parts), minlength=self.size)
        if same:
            share = same / len(codes)
            tf[self.size - 7 + min(6, int(share * 14))] = 1 + int(len(codes) * share)
        at = np.flatnonzero(tf)
        return at, tf[at]


class LexicalTerms:
    """Distinct lower-case letter runs of a text and their beginnings, hashed.

    Beginnings of four and five letters let inflected and compound forms of a word
    share evidence.
    """

    def __init__(self, size: int = 1 << 20) -> None:
        self.size = size
        self._cache: dict[str, tuple[int, ...]] = {}

    def _terms(self, word: str) -> tuple[int, ...]:
        if len(self._cache) >= _CACHE:
            self._cache.clear()
        found = [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) >= k)]
        self._cache[word] = terms = tuple(bucket(x, self.size) for x in found)
        return terms

    def _of(self, text: str) -> list[tuple[int, ...]]:
        get = self._cache.get
        return [get(word) or self._terms(word) for word in set(_LETTERS.findall(text.lower()))]

    def present(self, text: str) -> np.ndarray:
        """The buckets that occur, ascending."""
        found: set[int] = set()
        for terms in self._of(text):
            found.update(terms)
        return np.array(sorted(found), np.int64)

    def marked(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that occur, ascending, and whether each is that of a whole word."""
        whole = {terms[0] for terms in self._of(text)}
        at = self.present(text)
        return at, np.fromiter((x in whole for x in at.tolist()), bool, len(at))
