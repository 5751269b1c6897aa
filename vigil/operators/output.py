"""Detections as one table, and to sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.errors import PlanError
from vigil.operators.engine import Engine
from vigil.plans.correlation import Correlation
from vigil.plans.rules import Rule
from vigil.sources.rules import Collection


def detections(engine: Engine, rules: Collection) -> DataFrame:
    """All wanted results in one form: ``rule_id``, ``rule_title``, ``level``, ``tags`` and the row as JSON in ``event``.

    Detection rules share scans; correlations are added by union.
    """
    wanted = rules.output_rules()
    plain = [r for r in wanted if isinstance(r, Rule)]
    out: list[DataFrame] = []
    if plain:
        tagged = engine.tagged(plain)
        rest = [c for c in tagged.columns if c not in ("rule_id", "rule_title", "level", "tags")]
        out.append(tagged.select("rule_id", "rule_title", "level", "tags", F.to_json(F.struct(*rest)).alias("event")))
    for r in wanted:
        if isinstance(r, Correlation):
            level = F.lit(r.meta.level.value if r.meta.level else None).cast("string").alias("level")
            tags = F.array(*[F.lit(str(t)) for t in r.meta.tags]).cast("array<string>").alias("tags")
            out += [df.select(F.lit(r.key).alias("rule_id"), F.lit(r.title).alias("rule_title"), level, tags, F.to_json(F.struct("*")).alias("event")) for df in engine.matches(r, rules)]
    if not out:
        raise PlanError("no rule gives a result")
    union = out[0]
    for df in out[1:]:
        union = union.unionByName(df)
    return union


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """To files, by rule or level if wanted."""
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
