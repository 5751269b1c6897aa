"""Operator 5: toxicity by a factorization machine over hashed terms.

Each text is the set of its distinct letter runs and their beginnings, hashed. On a bounded
sample of labelled rows a second-order factorization machine is trained by adaptive
gradient steps: besides a weight each term has a factor vector, and the products of
factor vectors are the pairwise interactions that additive weights miss.

The machine has all terms for which the sample holds evidence, however many they are:
terms whose presence depends on the label (chi-square of ``EVIDENCE`` or more, which
chance exceeds once in a thousand), and both terms of pairs of words whose joint presence
shifts the label by ``PAIR_EVIDENCE`` standard deviations or more from what single terms
and either word say, so that a word that matters only next to another is learnt too. Other terms would
only learn the sample by heart.

``SAMPLE`` bounds the labelled rows that are used, ``PAIR_SAMPLE`` those in which pairs
are looked for. Labels come only from rows outside
the held-out fold; labels, language, source and id are never inputs of a score.

Edge cases: null and empty texts have no terms and score the bias; with labels of
one class only every score is that class's; with none, 0.5; every row gives one row;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import U64, crc_remainder, mix64, working
from vigil.llm.sample import labelled
from vigil.llm.terms import LexicalTerms

SAMPLE = 16_384
EVIDENCE = 10.83
PAIR_EVIDENCE = 6.0
PAIR_ROWS = 8  # texts that a pair must be in
PAIR_SAMPLE = 2048  # labelled rows in which pairs are looked for
FACTORS = 8
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0

_TERMS: list[LexicalTerms] = []


def terms() -> LexicalTerms:
    if not _TERMS:
        _TERMS.append(LexicalTerms())
    working("toxicity", _TERMS.clear)
    return _TERMS[0]


@dataclass
class FactorizationMachine:
    kept: np.ndarray  # ascending buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def columns(self, present: np.ndarray) -> np.ndarray:
        """Positions among the kept terms."""
        if not len(self.kept):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.kept, present), len(self.kept) - 1)
        return at[self.kept[at] == present]

    def score(self, present: np.ndarray) -> float:
        at = self.columns(present)
        v = self.factors[at]
        total = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def chi_square(docs: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Dependence of each term's presence on the label."""
    n, positive = len(y), y.sum()
    both, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for at in range(0, n, 1024):
        part = list(zip(docs[at : at + 1024], y[at : at + 1024], strict=True))
        every += np.bincount(np.concatenate([d for d, _ in part]), minlength=size)
        both += np.bincount(np.concatenate([d for d, z in part if z] or [np.empty(0, np.int64)]), minlength=size)
    expected = every * positive / n
    spread = np.maximum(every * (n - every) / n * positive * (n - positive) / n, 1e-9)
    return np.where(every > 1, n * (both - expected) ** 2 / spread, 0)


def _pairs(words: list[np.ndarray], rows: int = 256, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, first and second word of all pairs, some at a time."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def batch() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat([d for d, _, _ in held], [len(a) for _, a, _ in held]), np.concatenate([a for _, a, _ in held]), np.concatenate([b for _, _, b in held])

    for d, w in enumerate(words):
        for at in range(0, len(w) - 1, rows):
            first, second = np.nonzero(np.arange(len(w))[None, :] > np.arange(at, min(at + rows, len(w) - 1))[:, None])
            held.append((d, w[first + at], w[second]))
            size += len(first)
            if size >= most:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def paired_terms(words: list[np.ndarray], y: np.ndarray, p: np.ndarray, size: int, evidence: float = PAIR_EVIDENCE, bits: int = 20) -> np.ndarray:
    """Words of pairs whose texts have other labels than the probabilities ``p`` and either word by itself say.

    The rest of a text's label is compared with the mean rest of all texts of the first
    and of the second word: both sums must stand out, so that the words of a family of
    like texts, none of which says more with another, aren't pairs. Pairs are summed by
    hash first; those of sums that stand out are then summed one by one.
    """
    if not words:
        return np.empty(0, np.int64)
    n = np.bincount(np.concatenate(words), minlength=size)
    words = [w[n[w] >= PAIR_ROWS] for w in words]
    rest, spread = y - p, p * (1 - p)
    sizes = [len(w) for w in words]
    mean = np.bincount(np.concatenate(words), np.repeat(rest, sizes), minlength=size) / np.maximum(n, 1)

    def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix64((a * size + b).astype(U64)) >> U64(64 - bits)).astype(np.int64)

    def sums(at: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        return np.stack([np.bincount(at, x, length) for x in (rest[d] - mean[a], rest[d] - mean[b], spread[d], np.ones(len(d)))])

    def stands_out(total: np.ndarray) -> np.ndarray:
        bound = evidence * np.sqrt(np.maximum(total[2], 1e-3 * total[3]))
        return (total[3] >= PAIR_ROWS) & (np.abs(total[0]) >= bound) & (np.abs(total[1]) >= bound)

    total = np.zeros((4, 1 << bits))
    for d, a, b in _pairs(words):
        total += sums(slot(a, b), d, a, b, 1 << bits)
    seen = stands_out(total)
    if not seen.any():
        return np.empty(0, np.int64)
    parts = []
    for d, a, b in _pairs(words):
        keep = np.flatnonzero(seen[slot(a, b)])
        if len(keep):
            d, a, b = d[keep], a[keep], b[keep]
            own, at = np.unique(a * size + b, return_inverse=True)
            parts.append((own, sums(at, d, a, b, len(own))))
    pairs, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    total = np.stack([np.bincount(place, x, len(pairs)) for x in np.concatenate([x for _, x in parts], axis=1)])
    pairs = pairs[stands_out(total)]
    return np.unique(np.concatenate([pairs // size, pairs % size]))


def _descend(docs: list[np.ndarray], y: np.ndarray, kept: np.ndarray, factors: int, epochs: int, rate: float, decay: float, seed: int) -> FactorizationMachine:
    model = FactorizationMachine(kept, float(np.log(y.mean() / (1 - y.mean()))), np.zeros(0), np.zeros((0, factors)))
    m = len(kept)
    rng = np.random.default_rng(seed)
    model.weights, model.factors = np.zeros(m), rng.normal(0, 0.02, (m, factors))
    rows = [model.columns(d) for d in docs]
    sums = [np.full(1, 1e-6), np.full(m, 1e-6), np.full((m, factors), 1e-6)]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 256):
            part = order[start : start + 256]
            # the columns that the batch has; others have no gradient but decay
            used, at = np.unique(np.concatenate([rows[k] for k in part]), return_inverse=True)
            x = np.zeros((len(part), len(used)), np.float32)
            x[np.repeat(np.arange(len(part)), [len(rows[k]) for k in part]), at] = 1
            w, v = model.weights[used], model.factors[used]
            xv = x @ v
            total = model.bias + x @ w + 0.5 * ((xv**2) - x @ (v**2)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(total, -40, 40))) - y[part]) / len(part)
            xe = x.T @ error
            steps = [np.array([error.sum()]), xe + decay * w, x.T @ (error[:, None] * xv) - xe[:, None] * v + decay * v]
            sums[0] += steps[0] ** 2
            sums[1][used] += steps[1] ** 2
            sums[2][used] += steps[2] ** 2
            model.bias -= float(rate * steps[0][0] / np.sqrt(sums[0][0]))
            model.weights[used] -= rate * steps[1] / np.sqrt(sums[1][used])
            model.factors[used] -= rate * steps[2] / np.sqrt(sums[2][used])
    return model


def fit(
    sample: list[tuple[int, np.ndarray, np.ndarray | None]], size: int, evidence: float = EVIDENCE, factors: int = FACTORS, epochs: int = 20, rate: float = 0.1, decay: float = 2e-4, seed: int = 11
) -> FactorizationMachine:
    """``sample``: label, terms, and which of them are words, all if None."""
    y = np.array([label for label, _, _ in sample], np.float32)
    empty = FactorizationMachine(np.empty(0, np.int64), 0.0, np.empty(0), np.empty((0, factors)))
    if not len(y) or y.min() == y.max():
        empty.bias = 0.0 if not len(y) else 40.0 * (2 * float(y[0]) - 1)
        return empty
    docs = [at for _, at, _ in sample]
    alone = np.flatnonzero(chi_square(docs, y, size) >= evidence)
    base = _descend(docs, y, alone, 0, epochs, rate, decay, seed)
    p = np.array([base.score(d) for d in docs])
    chosen = np.random.default_rng(seed).permutation(len(y))[:PAIR_SAMPLE]
    marks = [(docs[i].astype(np.int64), sample[i][2]) for i in chosen]
    words = [d if mark is None else d[mark.astype(bool)] for d, mark in marks]
    kept = np.union1d(alone, paired_terms(words, y[chosen], p[chosen], size))
    return _descend(docs, y, kept, factors, epochs, rate, decay, seed)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    return fit(labelled(docs, labels, "toxic", FOLDS, HELD_OUT, sample, lambda text: terms().marked(text), "u1"), terms().size)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = terms()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                scores = [model.score(own.present(x or "")) for x in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
