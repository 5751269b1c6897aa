"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for all nodes of (u, v) edges.

    Large-star links the greater neighbours of each node to its smallest one,
    small-star the smaller neighbours and the node itself; when nothing changes, all
    that remains is stars around the roots. Minima are combined before the shuffle and
    written, so that the join with them is one of two tables, in which a node with
    many neighbours can be split.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _checksum(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = _checksum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
