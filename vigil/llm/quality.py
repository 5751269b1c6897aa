"""Operator 4: quality by nearest-neighbour voting in latent-semantic space.

Texts become hashed word, shape and shape-pair counts, weighted by log count and
inverse document frequency, and projected on the leading right singular vectors of
a labelled sample. The sample's unit vectors and labels travel with the task; each
block of documents is multiplied with all of them, which gives exact cosines, and
the ``NEIGHBOURS`` nearest vote with a power of their similarity.

``SAMPLE`` bounds the labelled rows that are used; nothing else is bounded. Labels
come only from rows outside the held-out fold, and labels, language, source and id
are never inputs of a score.

Edge cases: null and empty texts are the same single term and get a score like any
other; with no usable labels every score is 0.5; every row gives one row; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import crc_remainder, working
from vigil.llm.sample import labelled
from vigil.llm.terms import StyleTerms

SAMPLE = 4096
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_TERMS: list[StyleTerms] = []


def terms() -> StyleTerms:
    if not _TERMS:
        _TERMS.append(StyleTerms())
    working("quality", _TERMS.clear)
    return _TERMS[0]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class NearestNeighbours:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.idf) @ self.projection)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** SHARPNESS + 1e-12
        return np.clip((weights * self.labels[nearest]).sum(axis=1) / weights.sum(axis=1), 0, 1)


def fit(sample: list[tuple[int, np.ndarray, np.ndarray]], size: int, rank: int = RANK, seed: int = 7) -> NearestNeighbours:
    """Inverse document frequencies, singular vectors by subspace iteration, and the sample's vectors."""
    counts = np.zeros((len(sample), size), np.float32)
    for i, (_, at, values) in enumerate(sample):
        counts[i, at] = values
    idf = np.log((1 + len(sample)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    weighted = _unit(np.log1p(counts) * idf)
    rank = max(1, min(rank, len(sample)))
    basis = np.random.default_rng(seed).standard_normal((size, rank + 16)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    rotation = np.linalg.svd(weighted @ basis, full_matrices=False)[2] if len(sample) else np.eye(basis.shape[1])
    projection = (basis @ rotation.T)[:, :rank].astype(np.float32)
    return NearestNeighbours(idf, projection, _unit(weighted @ projection), np.array([y for y, _, _ in sample], np.float64))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NearestNeighbours:
    return fit(labelled(docs, labels, "quality", FOLDS, HELD_OUT, sample, lambda text: terms().counts(text)), terms().size)


def scored(docs: DataFrame, model: NearestNeighbours) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = terms()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts = np.zeros((part.num_rows, own.size), np.float32)
                for i, text in enumerate(part["text"].to_pylist()):
                    at, values = own.counts(text or "")
                    counts[i, at] = values
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.scores(counts), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    out = scored(docs, train(docs, labels, sample))
    return out.select("doc_id", (crc_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows whose text reaches the threshold, with all their columns."""
    model = train(docs, labels, sample)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = terms()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts = np.zeros((part.num_rows, own.size), np.float32)
                for i, text in enumerate(part["text"].to_pylist()):
                    at, values = own.counts(text or "")
                    counts[i, at] = values
                yield part.filter(pa.array(model.scores(counts) >= threshold))

    return docs.select(*columns).mapInArrow(run, docs.schema)
