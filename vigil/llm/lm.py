"""Operator 7: cross-entropy difference of two n-gram models.

A background model is counted on all documents and a target model on the documents
marked as wanted. Both are bigram models with the same smoothing over one shared
vocabulary. Words, contexts and bigrams are counted by 64-bit keys in a table that
grows with the corpus and is never in one place. Documents are gathered in chunks of
about ``CHUNK`` words. Each chunk asks with its distinct keys and own counts, so that
a common key comes once a chunk; a word is one key with two counts, as word and as context.
What moves between tasks is packed and compressed by the workers. Slices of the table, ranges of keys, sum them and
answer each chunk with the totals. The number of slices grows with the words. The
vocabulary is the distinct words of the corpus and one that stands for all others, so
that the probabilities of each context sum to one.

A document's score is the mean over its words of target loss less background loss:
the lower, the more like the target. A document's own counts are taken out of the
models that hold it before it is scored, so that it doesn't predict itself.

Edge cases: null and empty texts have no words and losses and score 0; with no
target documents the target model is uniform; ids that repeat are rows of their own,
and an id is wanted if any of its labels says so; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import U64, mix64, n_partitions, stored, working

UNIGRAM_SMOOTHING = 0.5
BIGRAM_SMOOTHING = 20.0
BROADCAST_IDS = 2_000_000
CHUNK = 1 << 20
SLICE = 1 << 21  # words a slice of the table, in the mean
_CACHE = 400_000
_FACTOR = U64(0xD6E8FEB86659FD93)


class _Ids(dict):
    """64-bit ids of lower-cased words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = i = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace"))
        return i


_IDS = _Ids()


def word_ids(text: str | None) -> np.ndarray:
    """Ids of the words, after the id 0 of the beginning."""
    words = (text or "").split()
    return np.concatenate([np.zeros(1, U64), np.fromiter(map(_IDS.__getitem__, words), U64, len(words))])


def bigram_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(contexts * _FACTOR + words)


def bigram_ids(ids: np.ndarray) -> np.ndarray:
    return bigram_keys(ids[:-1], ids[1:])


def times(values: np.ndarray) -> np.ndarray:
    """For each value how often it occurs among them."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[at]


_CODEC = pa.Codec("zstd", 1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length by planes of bytes, compressed here, so that the JVM only holds and moves what is left."""
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns)
    return struct.pack("<I", len(planes)) + _CODEC.compress(planes, asbytes=True)


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(x).itemsize for x in kinds]
    (length,) = struct.unpack_from("<I", data)
    planes = np.frombuffer(_CODEC.decompress(memoryview(data)[4:], length) if length else b"", np.uint8).reshape(sum(sizes), -1)
    cuts = np.cumsum(sizes)[:-1]
    return [np.ascontiguousarray(x.T).view(kind).reshape(-1) for x, kind in zip(np.split(planes, cuts), kinds, strict=True)]


def _steps(ascending: np.ndarray) -> np.ndarray:
    """The differences, whose high bytes are alike. Sums of them give the values again."""
    return np.diff(ascending, prepend=U64(0))


_CHUNK = "docs array<long>, wanted binary, sizes binary, vocabulary binary, at binary, words long, wanted_words long"
_CHUNK_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as places in the distinct word ids of their chunk, the most frequent first."""
    working("lm", _IDS.clear)
    docs: list[int | None] = []
    flags: list[bool] = []
    texts: list[np.ndarray] = []

    def chunk() -> pa.RecordBatch:
        sizes = np.array([len(x) for x in texts], np.int64)
        wanted = np.array(flags, np.uint8)
        vocabulary, at, n = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        row = [pa.array([docs], pa.list_(pa.int64()))]
        row += [pa.array([x], pa.binary()) for x in (_pack(wanted), _pack(sizes), _pack(vocabulary[often]), _pack(rank[at]))]
        row += [pa.array([int(x)], pa.int64()) for x in ((sizes - 1).sum(), (sizes - 1)[wanted == 1].sum())]
        return pa.RecordBatch.from_arrays(row, _CHUNK_NAMES)

    held = 0
    for batch in batches:
        for doc_id, text, flag in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            ids = word_ids(text)
            docs.append(doc_id)
            flags.append(flag)
            texts.append(ids)
            held += len(ids)
            if held >= CHUNK:
                yield chunk()
                docs, flags, texts, held = [], [], [], 0
    if docs:
        yield chunk()


class Chunk:
    """The n-grams of a chunk: ``keys`` are its words and its bigrams, and an occurrence is a place of a word, a context and a bigram."""

    def __init__(self, wanted: bytes, sizes: bytes, vocabulary: bytes, at: bytes) -> None:
        (ids,), (places,), (lengths,) = _unpack(vocabulary, U64), _unpack(at, np.int32), _unpack(sizes, np.int64)
        self.n = lengths - 1
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), self.n)
        self.wanted = _unpack(wanted, np.uint8)[0].astype(bool)
        inside = np.ones(len(places), bool)
        inside[np.cumsum(lengths) - lengths] = False
        at_word = np.flatnonzero(inside)
        word, context = places[at_word], places[at_word - 1]
        pairs, pair = np.unique(bigram_keys(ids[context], ids[word]), return_inverse=True)
        self.n_ids = len(ids)
        self.keys = np.concatenate([ids, pairs])
        # places in the keys, of which a chunk has far less than 2^31
        self.word, self.context, self.pair = word, context, (pair + len(ids)).astype(np.int32)
        self.order = np.argsort(self.keys, kind="stable").astype(np.int32)

    def counts(self) -> list[np.ndarray]:
        """How often each key occurs in all and in the wanted documents; then by how much less a word is a context, as after the last word of a document."""
        flag = self.wanted[self.doc]
        found = [[np.bincount(x[f], minlength=len(self.keys)).astype(np.int64) for f in (slice(None), flag)] for x in (self.word, self.context, self.pair)]
        return [w + p for w, _, p in zip(*found, strict=True)] + [w - c for w, c, _ in zip(*found, strict=True)]

    def losses(self, counts: np.ndarray, totals: tuple[int, int], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability of each document's words by the target and by the background, from the sums of all chunks' counts."""
        own = [times(self.doc.astype(np.int64) * len(self.keys) + x).astype(np.int32) for x in (self.pair, self.context, self.word)]
        found = []
        for (every, less), total, out in ((counts[1::2], totals[1], self.wanted[self.doc]), (counts[::2], totals[0], True)):
            bigrams, contexts, words = (x - o * out for x, o in zip((every[self.pair], every[self.context] - less[self.context], every[self.word]), own, strict=True))
            unigram = (words + UNIGRAM_SMOOTHING) / (total - self.n[self.doc] * out + UNIGRAM_SMOOTHING * vocabulary)
            p = (bigrams + BIGRAM_SMOOTHING * unigram) / (contexts + BIGRAM_SMOOTHING)
            found.append(np.bincount(self.doc, -np.log(p), len(self.n)) / np.maximum(self.n, 1))
        return found[0], found[1]


_ASK = "chunk long, slice int, keys binary, counts binary"
_ASK_NAMES = [x.split()[0] for x in _ASK.split(", ")]
_COUNTS = (np.int64,) * 4


def _asks(slices: int) -> object:
    """Each chunk's keys and counts, one row for each slice that holds some."""
    cuts = np.array([i * 2**64 // slices for i in range(1, slices)], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1).to_pylist()[0]
                own = Chunk(part["wanted"], part["sizes"], part["vocabulary"], part["at"])
                keys, counts = own.keys[own.order], [x[own.order] for x in own.counts()]
                words = (own.order < own.n_ids).astype(np.uint8)
                ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                used = [i for i in range(slices) if ends[i + 1] > ends[i]]
                parts = [slice(ends[i], ends[i + 1]) for i in used]
                columns = [pa.array([_pack(_steps(keys[x])) for x in parts], pa.binary()), pa.array([_pack(words[x], *(y[x] for y in counts)) for x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([part["chunk"]] * len(used), pa.int64()), pa.array(used, pa.int32()), *columns], _ASK_NAMES)

    return run


_ANSWER = "chunk long, slice int, totals binary, distinct long"
_ANSWER_NAMES = [x.split()[0] for x in _ANSWER.split(", ")]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of what chunks ask for, in their order. Rows come by slice."""

    def answer(rows: list[dict]) -> pa.RecordBatch:
        asked = [np.cumsum(_unpack(r["keys"], U64)[0]) for r in rows]
        words, *counts = (np.concatenate(x) for x in zip(*(_unpack(r["counts"], np.uint8, *_COUNTS) for r in rows), strict=True))
        keys = np.concatenate(asked)
        order = np.argsort(keys, kind="stable")
        ascending = keys[order]
        first = np.concatenate([[True], ascending[1:] != ascending[:-1]])
        at, group = np.flatnonzero(first), np.cumsum(first) - 1
        sums = [np.add.reduceat(x[order], at) for x in counts]
        totals = np.empty((len(sums), len(keys)), np.int64)
        for x, back in zip(sums, totals, strict=True):
            back[order] = x[group]
        is_word = words[order][at]
        # the beginning is no word: it is never counted as one
        distinct = int((is_word.astype(bool) & (sums[0] > 0)).sum())
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        packed = [_pack(*x) for x in np.split(totals, cuts, axis=1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["slice"] for r in rows], pa.int32()), pa.array(packed, pa.binary()), pa.array([distinct] + [0] * (len(rows) - 1), pa.int64())], _ANSWER_NAMES
        )

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["slice"] != rows[0]["slice"]:
                yield answer(rows)
                rows = []
            rows.append(row)
    if rows:
        yield answer(rows)


def _scores(totals: tuple[int, int], vocabulary: int) -> object:
    """Documents of chunks, each of which comes before its answers by slice."""

    def scored(part: dict, answers: list[dict]) -> pa.RecordBatch:
        own = Chunk(part["wanted"], part["sizes"], part["vocabulary"], part["at"])
        counts = np.empty((len(_COUNTS), len(own.keys)), np.int64)
        at = 0
        for a in answers:
            found = _unpack(a.pop("totals"), *_COUNTS)
            counts[:, own.order[at : at + len(found[0])]] = found
            at += len(found[0])
        if at != len(own.keys):
            raise ValueError(f"a chunk asked for {len(own.keys)} keys and {at} were answered")
        target, background = own.losses(counts, totals, vocabulary)
        return pa.RecordBatch.from_arrays([pa.array(part["docs"], pa.int64()), pa.array(own.n), pa.array(target), pa.array(background)], ["doc_id", "n_words", "target_loss", "background_loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: dict = {}
        answers: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["slice"] >= 0:
                    answers.append(row)
                    continue
                if part:
                    yield scored(part, answers)
                part, answers = row, []
        if part:
            yield scored(part, answers)

    return run


def _flagged(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and whether the row is wanted. Few ids are broadcast, more are joined by a shuffle."""
    ids = wanted.select(F.col("doc_id").cast("long").alias("wanted_id")).where("wanted_id IS NOT NULL").distinct()
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("wanted_id"), "left").select("doc_id", "text", F.col("wanted_id").isNotNull().alias("wanted"))


def score(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``target_loss``, ``background_loss`` and ``score`` of every row.

    ``wanted`` has the ``doc_id`` of target documents.
    """
    parts = n_partitions(docs.sparkSession)
    chunks = stored(_flagged(docs, wanted).mapInArrow(_chunks, _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks", "none")
    facts = chunks.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("wanted_words").alias("wanted"), F.max(F.shiftright("chunk", 33)).alias("last")).first()
    totals = facts["words"] or 0, facts["wanted"] or 0
    slices = parts * (1 + totals[0] // (parts * SLICE))
    asks = chunks.select("chunk", "wanted", "sizes", "vocabulary", "at").mapInArrow(_asks(slices), _ASK)
    dealt = asks.repartitionById(parts, F.col("slice") % parts).sortWithinPartitions("slice")
    answers = stored(dealt.mapInArrow(_answers, _ANSWER), "lm-answers", "none")
    distinct = answers.agg(F.sum("distinct")).first()[0] or 0
    each = chunks.select("chunk", F.lit(-1).alias("slice"), "docs", "wanted", "sizes", "vocabulary", "at")
    both = each.unionByName(answers.select("chunk", "slice", "totals"), allowMissingColumns=True)
    # chunks are numbered across tasks, and dealt in turn
    number = F.col("chunk").bitwiseAND(2**33 - 1) * ((facts["last"] or 0) + 1) + F.shiftright("chunk", 33)
    tasks = max(parts, facts["n"] // 4)
    together = both.repartitionById(tasks, (number % tasks).cast("int")).sortWithinPartitions("chunk", "slice")
    out = together.mapInArrow(_scores(totals, distinct + 1), "doc_id long, n_words long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def good_documents(labels: DataFrame) -> DataFrame:
    """The target of the query: documents labelled good and not toxic."""
    return labels.where("quality = 1 AND NOT coalesce(toxic, 0) = 1").select("doc_id")
