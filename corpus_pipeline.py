"""Documents to token files: quality, near-duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all
but the last return the columns of documents. Between stages the rows are written as
Parquet in the shared folder and read again; what a stage has read is then removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontam, mixing, neardup, quality, tokens
from vigil.llm.common import passing, remove, stored, table
from vigil.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: One stage keeps what its classifier accepts, and mixing draws by hash; SQL expresses neither model.
ORACLE_SQL: str | None = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, null ids last.

    Five words and a similarity of 0.8 or more. Rows without words stay.
    """
    return neardup.keep_first(docs, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities."""
    return mixing.sample(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    return tokens.round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("neardup", drop_near_duplicates),
    ("decontam", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_ids", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read: list[str] = []
    for name, stage in STAGES[:-1]:
        with passing() as paths:
            kept = stage(spark, docs, sf_dir)
        with passing() as written:
            docs = stored(kept, f"stage-{name}", "snappy")
        remove(spark, [*read, *paths])
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
