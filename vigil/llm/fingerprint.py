"""Operator 1: Lempel-Ziv phrase fingerprints.

Each text is parsed, over its UTF-8 bytes, into the phrases of an incremental
Lempel-Ziv dictionary: the shortest prefix of the rest that is not yet in the
dictionary is the next phrase. A phrase is named by a 64-bit rolling hash, so
parsing is one multiplication and one set look-up per byte. The fingerprint is
the bottom-k sketch of the phrase set (the k smallest mixed phrase hashes), and
the likeness of two fingerprints estimates the Jaccard similarity of the sets.

Edge cases: a null text is the empty text; an empty text has the empty
fingerprint, and two empty fingerprints have likeness 1, an empty and a
non-empty one 0. A last phrase that repeats an earlier one adds nothing. Rows
with equal ids are ordered by a hash of their text; null ids come first. Texts are
dealt by ranges of (id, hash), so rows that share an id are spread like others; only
rows equal in both are dealt to one task, which parses the text once. The
document after the last is the first, so a sole document follows itself. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import mix64, n_partitions

SKETCH = 128
SAMPLED = 64  # ids looked at for each part
_FIRST = -(1 << 63)  # stands for the hash of an id's first row
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_EMPTY = np.empty(0, np.uint32)


def parse(data: bytes, seen: set[int] | None = None, state: int = 0) -> tuple[set[int], list[int], int]:
    """Phrase hashes of ``data``: as a set, in order, and the state of the open phrase.

    ``seen`` and ``state`` continue an earlier parse.
    """
    seen = set() if seen is None else seen
    order: list[int] = []
    add, append, multiplier, mask = seen.add, order.append, _MULTIPLIER, _MASK
    for byte in data:
        state = (state * multiplier + byte + 1) & mask
        if state not in seen:
            add(state)
            append(state)
            state = 0
    return seen, order, state


def sketch(phrases: set[int], size: int = SKETCH) -> np.ndarray:
    """The ``size`` smallest mixed phrase hashes, ascending, by their upper 32 bits."""
    if not phrases:
        return _EMPTY
    hashes = (mix64(np.fromiter(phrases, np.uint64, len(phrases))) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * size:
        hashes = np.partition(hashes, 2 * size)[: 2 * size]
    return np.unique(hashes)[:size]


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated Jaccard similarity: the shared part of the smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, union[-1], side="right")) / len(union)


def fingerprint(text: str | None, size: int = SKETCH) -> np.ndarray:
    return sketch(parse((text or "").encode("utf-8", "replace"))[0], size)


def _follow(text: str, following: str, size: int) -> tuple:
    """What the query says of a text and the one after it, without the other's own fingerprint."""
    half = len(text) // 2
    keep = text[: len(text) - half]
    head = following[:half]
    seen, _, state = parse(keep.encode("utf-8", "replace"))
    edited_seen = set(seen)
    parse(text[len(keep) :].encode("utf-8", "replace"), seen, state)
    parse(head.encode("utf-8", "replace"), edited_seen, state)
    digest = hashlib.sha256((keep + head).encode("utf-8", "replace")).hexdigest()
    return sketch(seen, size), sketch(edited_seen, size), digest


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        out: list[tuple] = []
        held = None  # (id, text)
        waiting = None  # the finished part of the row before, which lacks near_next
        pair, followed = None, None  # repeated rows are parsed once

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return batch

        def complete(waiting: tuple, signature: np.ndarray) -> None:
            doc_id, n, digest, own, edited = waiting
            out.append((doc_id, n, digest, to_text(own), to_text(edited), likeness(own, edited, size), likeness(own, signature, size)))

        ended = False
        for batch in batches:
            for doc_id, text, tail in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["_tail"].to_pylist(), strict=True):
                if ended:
                    continue
                text = text or ""
                if held is not None:
                    if pair != (held[1], text):
                        pair, followed = (held[1], text), _follow(held[1], text, size)
                    own, edited, digest = followed
                    if waiting is not None:
                        complete(waiting, own)
                    waiting = (held[0], len(held[1]), digest, own, edited)
                held = (doc_id, text)
                if tail:
                    if waiting is not None:
                        complete(waiting, fingerprint(text, size))
                        waiting = None
                    ended = True
                if len(out) >= 512:
                    yield flush()
        if out:
            yield flush()

    return run


@dataclass
class Cuts:
    """Keys (id, hash of the text) of the rows that begin the parts, ascending; the least row's is the first.

    Null ids come before others. The hash is ``_FIRST`` for ids that begin one part only.
    """

    nulls: np.ndarray  # hashes, of null ids
    ids: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return max(1, len(self.nulls) + len(self.ids))

    def place(self, ids: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each row, and whether the row may begin it."""
        null = ids.is_null().to_numpy(zero_copy_only=False)
        values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(self.ids, values, side) for side in ("left", "right"))
        cut = high - 1
        equal = ~null & (high > low)
        for first in np.unique(low[equal]):
            rows = np.flatnonzero(equal & (low == first))
            cut[rows] = first + np.searchsorted(self.hashes[first : high[rows[0]]], hashes[rows], "right") - 1
        starts = np.zeros(len(values), bool)
        starts[equal] = (self.hashes[cut[equal]] == _FIRST) | (self.hashes[cut[equal]] == hashes[equal])
        part = cut + len(self.nulls)
        if null.any():
            part[null] = np.searchsorted(self.nulls, hashes[null], "right") - 1
            starts[null] = self.nulls[part[null]] == hashes[null]
        return part, starts


def cuts_of(rows: DataFrame, parts: int) -> Cuts:
    """About ``parts`` cuts of rows (doc_id, _hash), from a sample of as many ids for each part.

    Only ids are read, but for those that fill parts of their own: their hashes are
    sampled too. What comes to the driver grows with the parts, not with the rows.
    """
    facts = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.count("doc_id").alias("known")).first()
    fraction = min(1.0, SAMPLED * parts / max(1, facts["n"]))
    sample = rows.select("doc_id").sample(fraction, 7).toArrow()["doc_id"].to_pylist()
    sample.sort(key=lambda x: (x is not None, x or 0))
    picks = Counter(sample[i * len(sample) // parts] for i in range(parts) if sample)
    several = sorted(x for x, n in picks.items() if n > 1 and x is not None)
    null_rows = facts["n"] > facts["known"]
    least: dict[int | None, int] = {}
    more: dict[int | None, list[int]] = {}
    if several or null_rows:
        # at most half as many ids as parts
        wanted = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in (*several, None)], "wanted long"))
        hot = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("doc_id", "_hash")
        least = {r["doc_id"]: r["h"] for r in hot.groupBy("doc_id").agg(F.min("_hash").alias("h")).collect()}
        for r in hot.sample(fraction, 8).collect():
            more.setdefault(r["doc_id"], []).append(r["_hash"])

    def hashes(doc_id: int | None) -> list[int]:
        found, n = sorted(more.get(doc_id, [])), picks[doc_id]
        return sorted({least[doc_id], *(found[i * len(found) // n] for i in range(1, n) if found)})

    keys = []
    for doc_id in sorted({x for x in picks if x is not None} | ({facts["low"]} if facts["low"] is not None else set())):
        keys += [(doc_id, h) for h in (hashes(doc_id) if doc_id in least else [_FIRST])]
    return Cuts(np.array(hashes(None) if None in least else [], np.int64), *(np.array([k[i] for k in keys], np.int64) for i in (0, 1)))


def _deal(cuts: Cuts):
    """Rows with the part that they go to; rows that begin a part go to the part before too, as its tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(batch: pa.RecordBatch, part: np.ndarray, tail: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array(np.full(len(part), tail))], [*batch.schema.names, "_to", "_tail"])

        for batch in batches:
            part, starts = cuts.place(batch["doc_id"], batch["_hash"].to_numpy())
            yield sent(batch, part, False)
            at = np.flatnonzero(starts)
            if len(at):
                yield sent(batch.take(pa.array(at)), (part[at] - 1) % len(cuts), True)

    return run


def fingerprints(docs: DataFrame, size: int = SKETCH) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    One shuffle deals the texts by ranges of ``doc_id``. The first document of
    each range is also sent to the range before it, where it stands last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_hash", F.xxhash64("text"))
    cuts = cuts_of(rows, n_partitions(docs.sparkSession))
    dealt = (
        rows.mapInArrow(_deal(cuts), "doc_id long, text string, _hash long, _to int, _tail boolean")
        .repartitionById(len(cuts), F.col("_to"))
        .sortWithinPartitions("_tail", F.col("doc_id").asc_nulls_first(), "_hash")
    )
    return dealt.select("doc_id", "text", "_tail").mapInArrow(_rows(size), _SCHEMA)
