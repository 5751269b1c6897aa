"""Bounded samples of labelled documents, as hashed features on the driver."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import crc_remainder


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, size: int, features: Callable[[str], tuple[np.ndarray, np.ndarray]], kind: str = "<f4") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, columns, values) of at most ``size`` labelled documents outside the held-out fold.

    Which ones is settled by a hash of the id, whatever the order of rows; labels without
    a document don't count. Where an id has several labels the greatest holds; where it
    has several texts, each counts. ``kind`` is the type of the values.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .where(crc_remainder("doc_id", modulus) != held_out)
        .join(docs.select(F.col("doc_id").cast("long").alias("known_id")), F.col("doc_id").cast("long") == F.col("known_id"), "left_semi")
    )
    chosen = (
        known.groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max(F.col(column).cast("int")).alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(size)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the limit above bounds what is broadcast
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x or "") for x in batch["text"].to_pylist()]
            at = [x.astype("<i4").tobytes() for x, _ in found]
            values = [x.astype(kind).tobytes() for _, x in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "at", "values"])

    got = rows.mapInArrow(run, "doc_id long, label int, at binary, values binary").collect()
    # where ids repeat there may be more texts than ids: what goes is settled by a hash of the id, and by the text
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["at"])))
    got = sorted(got[:size], key=lambda r: (r["doc_id"], bytes(r["at"])))
    return [(r["label"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["values"], kind)) for r in got]
