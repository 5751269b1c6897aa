"""Operator 8: token ids in canonical length-limited Huffman files.

``write_ids`` encodes every whole text with a tokenizer, appends an end id, counts
all ids, builds one canonical code whose lengths are limited (package-merge), and
writes independent blocks in ascending ``doc_id`` order. Every block holds its own
document ids, lengths and bit-offset checkpoints, so blocks decode on their own, and
the stretches between checkpoints of a block decode side by side through one table.

The files are Parquet tables of binary blocks under ``path``: Spark's writer commits
them, so lost tasks leave nothing half-written, and any store Spark reads will do.
``codebook`` has one row with the length of each id's code; ``blocks`` has the
blocks with their part (range of ids), number, offset in ids and payload.

A payload: ``VHF1``; three little-endian uint32: documents, ids, checkpoint
interval; then for each document int64 id, uint8 whether it is null, and uint32
length; uint16 bits in each interval; and the code bits, highest first.

Rows are dealt by ranges of (``doc_id``, hash of the token ids, row), so rows that share
an id, or have none, are spread over as many tasks as they need.

Edge cases: a null text is the empty text and has just the end id; null ids come
first; rows with equal ids are all written, by a 64-bit hash of their token ids, so
that the order of the input makes no difference; an empty table gives an empty codebook
and no rows; more ids than codes of ``max_bits`` bits can hold get longer codes, up to
``WIDEST`` bits; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import mix64, n_partitions, passing, remove, shared_dir, stored, working, write

MAX_BITS = 17
WIDEST = 25  # a window of 32 bits, less the 7 that a code may start behind a byte
INTERVAL = 128
BLOCK_IDS = 1 << 18
CACHE = 700_000
CACHE_BYTES = 1 << 26
SEGMENT = 1 << 20
_MAGIC = b"VHF1"

# White space as the tokenizers library has it, without space and line break.
_ODD_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ODD_ASCII = "\t\x0b\x0c\r"
_SPACE = re.escape(_ODD_SPACE) + " \n"
# The fixed pattern of byte-level pre-tokenisation.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_RUNS = ["".join(x) for x in itertools.product(" \n", repeat=3)]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b < 127 or b > 160 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()

# Classes of bytes. Chunks are cut where a class below _MARK changes; beside the others nothing is cut.
_LETTER, _DIGIT, _SIGN, _BLANK, _BREAK, _MARK, _WIDE = range(7)
_CLASS = np.full(256, _WIDE, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = _LETTER if _c.isalpha() else _DIGIT if _c.isdigit() else _BLANK if _c == " " else _BREAK if _c == "\n" else _MARK if _c == "'" or _c in _ODD_SPACE else _SIGN

_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the lowest bytes of a word
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
FAR = 64  # bytes of a chunk beyond which the rest is looked at by itself


def _words(data: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian words, but for the last seven places."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _chunks(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start, and the class of each byte.

    A chunk starts with a document, with a space, with a line break and after it, and
    where ASCII letters, digits and signs meet. These are all ends of pieces.
    """
    kind = _CLASS[data]
    cut = np.zeros(len(data), bool)
    cut[doc_starts[doc_starts < len(data)]] = True
    cut |= (kind == _BLANK) | (kind == _BREAK)
    before, after = kind[:-1], kind[1:]
    cut[1:] |= (before == _BREAK) | ((before != after) & (before < _BLANK) & (after < _BLANK))
    return np.flatnonzero(cut), kind


class _Known(dict):
    """Numbers of chunks by hash; new ones get the next number."""

    def __missing__(self, key: int) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """A tokenizer, with a bounded cache of the ids of chunks where that is exact.

    Byte-level pre-tokenisation cuts texts into pieces that are encoded one by one.
    Texts in which white space comes in runs of three or more, in odd characters, or in a
    run at the end go to the tokenizer as they are. All others are cut into chunks
    that begin and end with pieces. A chunk of less than eight bytes is its own key; longer
    ones are found by 64-bit hashes. Only new ones are cut into pieces by the fixed pattern and
    encoded by the tokenizer's model. The bytes of every longer chunk are then compared with
    those that its hash stands for; texts with a chunk that differs go to the tokenizer.
    """

    def __init__(self, path: str, end_id: int = 0) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        before = about.get("pre_tokenizer") or {}
        self.chunked = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and about.get("normalizer") is None
        self.special = tuple(x["content"] for x in about.get("added_tokens") or ())
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.model = Tokenizer.from_file(path)
        if self.chunked:
            self.model.pre_tokenizer = None  # pieces need no more cutting
        # letters of each token, as the model sees them
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.ids = np.zeros(1 << 20, self.dtype)  # of all known chunks, one after the other
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.used = 0
        self.bytes = np.zeros(1 << 20, np.uint8)  # of all known chunks
        self.byte_starts = np.zeros(1 << 16, np.int32)
        self.byte_counts = np.zeros(1 << 16, np.int32)
        self.byte_used = 0

    def _plain(self, text: str) -> bool:
        """Whether cutting into chunks is exact."""
        if not self.chunked or any(s in text for s in self.special) or any(s in text for s in (_ODD_ASCII if text.isascii() else _ODD_SPACE)):
            return False
        return not any(r in text for r in _RUNS) and not text[-2:].isspace() if len(text) > 1 else True

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has. Where pieces end is told from the lengths of tokens."""
        ids, counts = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        groups = [[p.decode("latin-1").translate(_LETTERS) for p in pieces[i : i + 1000]] for i in range(0, len(pieces), 1000)]
        for group, e in zip(groups, self.model.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, self.dtype))
            ends = np.searchsorted(np.cumsum(self.sizes[ids[-1]]), np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))) + 1
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, chunks: list[bytes], several: list[bool]) -> None:
        """Append chunks to what is known. Those that may be of several pieces are cut by the pattern."""
        cut = [[p.encode("utf-8") for p in _PIECE.findall(c.decode("utf-8"))] if s else (c,) for c, s in zip(chunks, several, strict=True)]
        ids, counts = self._encode_pieces([p for x in cut for p in x])
        pieces = np.cumsum([0, *map(len, cut)])
        ends = np.concatenate([[0], np.cumsum(counts)])[pieces]
        sizes = np.fromiter(map(len, chunks), np.int32, len(chunks))
        n, first = len(chunks), len(self.known) - len(chunks)
        while len(self.starts) < first + n:
            self.starts, self.counts, self.byte_starts, self.byte_counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.byte_starts, self.byte_counts))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        size = int(sizes.sum())
        while len(self.bytes) < self.byte_used + size + 8:
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.byte_used : self.byte_used + size] = np.frombuffer(b"".join(chunks), np.uint8)
        self.byte_starts[first : first + n] = self.byte_used + np.cumsum(sizes) - sizes
        self.byte_counts[first : first + n] = sizes
        self.byte_used += size
        self.starts[first : first + n] = self.used + ends[:-1]
        self.counts[first : first + n] = np.diff(ends)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _cut_and_encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8") for t in texts]
        sizes = np.array([len(r) for r in raw])
        joined = b"".join([*raw, bytes(8)])
        data, words = np.frombuffer(joined, np.uint8)[:-8], _words(joined)
        doc_starts = np.cumsum(sizes) - sizes
        starts, kind = _chunks(data, doc_starts)
        ends = np.append(starts[1:], len(data))
        hashes, long = self._keys(joined, words, starts, ends - starts)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE or self.byte_used > CACHE_BYTES:
            self._forget()
        before = len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(numbers >= before)
        if len(new):
            at = first[new[np.argsort(numbers[new])]]
            several = (np.maximum.reduceat(kind, starts) >= _MARK)[at]
            self._learn([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], several.tolist())
        number = numbers[inverse]
        counts = self.counts[number]
        stops = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[number] - (stops - counts), counts) + np.arange(int(stops[-1]))]
        edges = np.concatenate([[0], stops])[np.append(np.searchsorted(starts, doc_starts), len(starts))] * self.dtype.itemsize
        packed = ids.tobytes()
        out = [packed[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        unlike = self._unlike(joined, words, number, starts, ends - starts, long)
        for i in np.unique(np.searchsorted(doc_starts, starts[unlike], side="right") - 1).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes()
        return out

    @staticmethod
    def _keys(joined: bytes, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A key for each chunk: its bytes and length, or a hash where it has eight bytes or more; and which have."""
        keys = (words[starts] & _MASKS[np.minimum(sizes, 8)]) | (np.minimum(sizes, 8) % 8).astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(sizes >= 8)
        start, size = starts[long], sizes[long]
        found = mix64(keys[long] * _FACTOR + size.astype(np.uint64))
        for at in range(8, FAR, 8):
            more = np.flatnonzero(size > at)
            if not len(more):
                break
            word = words[start[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]
            found[more] = mix64((found[more] ^ word) * _FACTOR)
        for i in np.flatnonzero(size > FAR).tolist():
            found[i] ^= np.uint64(xxhash.xxh3_64_intdigest(joined[start[i] + FAR : start[i] + size[i]]))
        keys[long] = found
        return keys, long

    def _unlike(self, joined: bytes, words: np.ndarray, number: np.ndarray, starts: np.ndarray, sizes: np.ndarray, long: np.ndarray) -> np.ndarray:
        """The chunks that don't have the bytes that their numbers stand for. A short key is the bytes, if lengths agree."""
        same = self.byte_counts[number] == sizes
        known = _words(self.bytes)
        long = long[same[long]]
        start, size, place = starts[long], sizes[long], self.byte_starts[number[long]]
        equal = np.ones(len(long), bool)
        for at in range(0, FAR, 8):
            more = np.flatnonzero(size > at)
            if not len(more):
                break
            mask = _MASKS[np.minimum(size[more] - at, 8)]
            equal[more] &= (words[start[more] + at] & mask) == (known[place[more] + at] & mask)
        for i in np.flatnonzero(size > FAR).tolist():
            equal[i] &= joined[start[i] + FAR : start[i] + size[i]] == self.bytes[place[i] + FAR : place[i] + size[i]].tobytes()
        same[long] = equal
        return np.flatnonzero(~same)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, the end id included."""
        out: list[bytes] = [b""] * len(texts)
        plain = [self._plain(x) for x in texts]
        cut = [i for i, x in enumerate(texts) if x and plain[i]]
        rest = [i for i, x in enumerate(texts) if x and not plain[i]]
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        # about SEGMENT characters at a time; longer texts are cut before spaces, where chunks start
        parts = [(i, segment) for i in cut for segment in _segments(texts[i])]
        at = 0
        while at < len(parts):
            size, end = len(parts[at][1]), at + 1
            while end < len(parts) and size + len(parts[end][1]) <= SEGMENT:
                size += len(parts[end][1])
                end += 1
            for (i, _), packed in zip(parts[at:end], self._cut_and_encode([x for _, x in parts[at:end]]), strict=True):
                out[i] += packed
            at = end
        return [x + self.end for x in out]


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SEGMENT:
        cut = text.rfind(" ", at + 1, at + SEGMENT)
        if cut < 0:
            cut = text.find(" ", at + SEGMENT)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = 0) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if (path, end_id) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    working("tokens", _ENCODERS.clear)
    return _ENCODERS[path, end_id]


def tokenize(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``doc_id``, ``n``, ``ids`` and ``key``, a hash of the ids: packed uint32 or, for small vocabularies, uint16. A map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = enc.encode_all([x or "" for x in part["text"].to_pylist()])
                n = [len(x) // enc.dtype.itemsize for x in ids]
                key = np.array([xxhash.xxh3_64_intdigest(x) for x in ids], np.uint64).view(np.int64)
                columns = [part["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([enc.dtype.itemsize] * len(n), pa.int32()), pa.array(key)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "width", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary, width int, key long")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits``, or of as many as all ids need, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.uint8)
    if n <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, (n - 1).bit_length())
    if max_bits > WIDEST:
        raise ValueError(f"{n} ids need more than {WIDEST} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels = [np.ones(n, bool)]
    merged = weights
    for _ in range(max_bits - 1):
        pairs = len(merged) // 2
        both = np.concatenate([weights, merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < n)
    take = 2 * n - 2
    found = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        found[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = found
    return lengths


def canonical_order(lengths: np.ndarray) -> np.ndarray:
    """Ids that have a code: by length, then by id."""
    used = np.flatnonzero(lengths)
    return used[np.lexsort((used, lengths[used]))]


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: the codes before it, counted in leaves at the greatest length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = canonical_order(lengths)
    if len(order):
        free = (int(lengths.max()) - lengths[order].astype(np.int64)).astype(np.uint64)
        leaves = np.uint64(1) << free
        codes[order] = (np.cumsum(leaves) - leaves) >> free
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, interval: int) -> tuple[np.ndarray, bytes]:
    """Bits in each interval, and the bits."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    offsets = ends - sizes
    word, shift = offsets >> 5, (64 - (offsets & 31) - sizes).astype(np.uint64)
    value = codes[ids] << shift
    words = (int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 0
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    marks = np.append(offsets[::interval], ends[-1:])
    return np.diff(marks), (high + low).astype(np.uint32).astype(">u4").tobytes()[: int(ends[-1]) + 7 >> 3 if len(ids) else 0]


def encode_block(doc_ids: list[int | None], docs: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray, interval: int = INTERVAL) -> bytes:
    ids = np.concatenate(docs)
    if interval * int(lengths.max(initial=0)) >= 1 << 16:
        raise ValueError(f"the bits of {interval} ids may not fit a checkpoint of 16 bits")
    steps, bits = pack_bits(ids, codes, lengths, interval)
    return b"".join(
        [
            _MAGIC,
            struct.pack("<III", len(docs), len(ids), interval),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], "u1").tobytes(),
            np.array([len(x) for x in docs], "<u4").tobytes(),
            steps.astype("<u2").tobytes(),
            bits,
        ]
    )


class Decoder:
    """Table-driven: the next bits index a table of ids and code lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.width = max(1, int(lengths.max(initial=0)))
        order = canonical_order(lengths)
        leaves = 1 << (self.width - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.width, np.uint32)
        self.sizes = np.zeros(1 << self.width, np.int64)
        self.ids[: leaves.sum()] = np.repeat(order, leaves)
        self.sizes[: leaves.sum()] = np.repeat(lengths[order], leaves)

    def bits(self, data: np.ndarray, steps: np.ndarray, count: int, interval: int) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = padded[:-3] << np.uint32(24) | padded[1:-2] << np.uint32(16) | padded[2:-1] << np.uint32(8) | padded[3:]
        at = np.cumsum(steps) - steps
        out = np.empty((interval, len(steps)), np.uint32)
        last, mask, shift = len(window) - 1, (1 << self.width) - 1, 32 - self.width
        for k in range(interval):
            value = window[np.minimum(at >> 3, last)].astype(np.int64) >> (shift - (at & 7)) & mask
            out[k] = self.ids[value]
            at += self.sizes[value]
        return out.T.reshape(-1)[:count]

    def block(self, payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Document ids, their lengths, and all ids of the block."""
        if payload[:4] != _MAGIC:
            raise ValueError("not a block")
        n, count, interval = struct.unpack_from("<III", payload, 4)
        at = 16
        doc_ids = np.frombuffer(payload, "<i8", n, at)
        null = np.frombuffer(payload, "u1", n, at + 8 * n)
        sizes = np.frombuffer(payload, "<u4", n, at + 9 * n)
        at += 13 * n
        lanes = -(-count // interval)
        steps = np.frombuffer(payload, "<u2", lanes, at).astype(np.int64)
        data = np.frombuffer(payload, np.uint8, -1, at + 2 * lanes)
        return [None if z else int(x) for x, z in zip(doc_ids, null, strict=True)], sizes, self.bits(data, steps, count, interval)


def _unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs; as long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width in set(batch["width"].to_pylist()):
                own = batch.filter(pc.equal(batch["width"], width))["ids"]
                more = np.bincount(_unpack(b"".join(own.to_pylist()), width))
                if len(more) > len(total):
                    more[: len(total)] += total
                    total = more
                else:
                    total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "count"])

    rows = tokens.select("ids", "width").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["count"].to_numpy(np.int64)
    return counts


def _blocks(lengths: np.ndarray, interval: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = number = offset = 0
        bucket = None

        def block() -> pa.RecordBatch:
            nonlocal size, number, offset
            payload = encode_block(held_ids, held, codes, lengths, interval)
            batch = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((bucket, pa.int32()), (number, pa.int64()), (offset, pa.int64()), (size, pa.int64()), (payload, pa.binary()))], ["part", "block", "offset", "n_ids", "payload"])
            offset, number, size = offset + size, number + 1, 0
            held_ids.clear()
            held.clear()
            return batch

        for batch in batches:
            for doc_id, data, width, bucket in zip(batch["doc_id"].to_pylist(), batch["ids"], batch["width"].to_pylist(), batch["part"].to_pylist(), strict=True):  # noqa: B020
                held_ids.append(doc_id)
                held.append(_unpack(data.as_py(), width))
                size += len(held[-1])
                if size >= block_ids:
                    yield block()
        if held:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, max_bits: int = MAX_BITS, interval: int = INTERVAL, block_ids: int = BLOCK_IDS) -> None:
    """Encode, count, code and write. Texts are tokenised once; only packed ids are shuffled."""
    spark = docs.sparkSession
    with passing() as paths:
        tokens = stored(tokenize(docs, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()), "ids")
    lengths = code_lengths(id_counts(tokens), max_bits)
    spark.createDataFrame(pd.DataFrame({"lengths": [lengths.tobytes()]}), "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    ordered = (
        tokens.repartitionByRange(n_partitions(spark), F.col("doc_id").asc_nulls_first(), "key", "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
        .select("doc_id", "ids", "width", F.spark_partition_id().alias("part"))
    )
    write(ordered.mapInArrow(_blocks(lengths, interval, block_ids), "part int, block long, offset long, n_ids long, payload binary"), f"{path}/blocks", "none")
    remove(spark, paths)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` (array), or ``ids_crc32`` in its place."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()["lengths"], np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row per part, of which there are as many as shuffle partitions
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    kind = pa.int64() if digest else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for part, offset, payload in zip(batch["part"].to_pylist(), batch["offset"].to_pylist(), batch["payload"], strict=True):
                doc_ids, sizes, ids = decoder.block(payload.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                pieces = np.split(ids.astype("<u4"), ends[:-1])
                last = [zlib.crc32(x.tobytes()) for x in pieces] if digest else [x.tolist() for x in pieces]
                start = base[part] + offset + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(last, kind)], ["doc_id", "start", "n_tokens", "last"])

    name, ddl = ("ids_crc32", "long") if digest else ("ids", "array<long>")
    out = blocks.select("part", "offset", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, last {ddl}")
    return out.withColumnRenamed("last", name)


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the files, read them back, and digest what they hold."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(spark, path, digest=True)
