"""Spans of kinds in a text: joining them to strings and emitting one row per document."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end``, comma-joined, by start and then in the order of ``kinds``."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    ordered = sorted(spans, key=lambda s: (s[1], rank.get(s[0], len(rank)), s[0], s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


class Taken:
    """Intervals that don't overlap, by place."""

    def __init__(self, intervals: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(intervals):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        """Whether nothing taken overlaps."""
        at = bisect.bisect_right(self.ends, start)
        return at == len(self.starts) or self.starts[at] >= end

    def add(self, start: int, end: int) -> None:
        at = bisect.bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def mapper(row: Callable[[str], tuple], schema: pa.Schema, size: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over Arrow batches of (doc_id, text): ``row(text)`` gives what follows doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                rows = [row(text or "") for text in part["text"].to_pylist()]
                columns = zip(*rows, strict=True)
                arrays = [part["doc_id"], *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run
