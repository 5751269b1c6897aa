"""Helpers that several operators share: tables, shared scratch space and ordered dealing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="vigil-")
        folder = _OWN_DIRS[app]
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Write ``df`` as Parquet. The shuffle files that this took are removed at its end, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing() -> Iterator[list[str]]:
    """The paths of tables that are stored within, to ``remove`` when nothing reads them any more."""
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield paths
    finally:
        _PASSING.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and fixes non-deterministic
    columns such as generated row ids.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _PASSING.get():
        paths.append(path)
    write(df, path, codec)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict[str, Callable[[], object]] = {}


def working(owner: str, forget: Callable[[], object]) -> None:
    """Say that this worker process now works for ``owner``, whose cache ``forget`` empties; other caches are emptied."""
    for name in [n for n in _HELD if n != owner]:
        _HELD.pop(name)()
    _HELD[owner] = forget


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that structured input spreads evenly."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _scanned(df: DataFrame) -> bool:
    """Whether ``df`` is just what a folder of Parquet files holds, each once, so that a row is told by its file and place."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and plan.relation().location().rootPaths().size() == 1


def with_rows(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a number for each row, and the name of that column, which no other column has.

    The rows of files are numbered where they are, by file and place; others are written first.
    """
    row = "_row"
    while row.lower() in {c.lower() for c in df.columns}:
        row += "_"
    if _scanned(df):
        at = df.metadataColumn("_metadata")
        paths = sorted(r[0] for r in df.select(at["file_path"]).distinct().collect())
        files = df.sparkSession.createDataFrame(list(enumerate(paths)), f"{row}file long, {row}path string")
        numbered = df.select("*", at["file_path"].alias(f"{row}at"), at["row_index"].alias(row)).join(F.broadcast(files), F.col(f"{row}at") == F.col(f"{row}path"))
        return numbered.select(*[df[c] for c in df.columns], (F.shiftleft(f"{row}file", 40) + F.col(row)).alias(row)), row
    return stored(df.withColumn(row, F.monotonically_increasing_id()), name), row


def without_rows(numbered: DataFrame, row: str, spare: DataFrame, few: int) -> DataFrame:
    """The rows whose number isn't in ``spare``, without it. Up to ``few`` numbers are broadcast, more are joined by a shuffle."""
    gone = f"{row}_gone"
    spare = stored(spare.select(F.col(spare.columns[0]).alias(gone)).distinct(), "spare")
    spare = F.broadcast(spare) if spare.count() <= few else spare
    return numbered.join(spare, numbered[row] == spare[gone], "left_anti").drop(row)
