"""Rules on streams: filters as they are, correlations as windows behind a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.errors import PlanError
from vigil.operators import correlate
from vigil.operators.correlate import RULE, TIME
from vigil.operators.engine import Engine
from vigil.plans.correlation import OPERATORS, Correlation, Kind
from vigil.plans.rules import Rule
from vigil.sources.rules import Collection


def stream_matches(engine: Engine, rules: list[Rule], columns: list[str] | None = None) -> DataFrame:
    """Events of streaming sources with the rules that they match; stateless."""
    return engine.tagged(rules, columns)


def _in_order(rules: list[str]) -> Column:
    """How many of the rules, from the first on, the window's events meet in listed order, each strictly later.

    A fold over the window's distinct (time, rule) pairs by time.
    """
    wanted = F.array(*[F.lit(r) for r in rules])
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("timestamp").alias("t"))

    def step(state: Column, event: Column) -> Column:
        next_ = (state["n"] < len(rules)) & (event[RULE] == F.try_element_at(wanted, state["n"] + 1))
        later = state["t"].isNull() | (event[TIME] > state["t"])
        return F.when(next_ & later, F.struct((state["n"] + 1).alias("n"), event[TIME].alias("t"))).otherwise(state)

    return F.aggregate(F.array_sort(F.collect_set(F.struct(TIME, RULE))), start, step, lambda s: s["n"])


def stream_correlation(engine: Engine, rule: Correlation, rules: Collection, delay: str = "10 minutes", slide: int | None = None) -> DataFrame:
    """Windows in which the correlation holds: keys, ``window_start``, ``ts`` (its end), ``value``.

    Windows are the time span long and begin every ``slide`` seconds (the span, if
    none is given). They close, and in append mode appear, when the watermark passes
    their end: events that are later than ``delay`` are dropped, and state of closed
    windows is freed. State is one buffer for each open window and group.
    """
    base = [rules[r] for r in rule.rules]
    if any(isinstance(r, Correlation) for r in base):
        raise PlanError("correlations of correlations run on batches only", rule.title)
    rewritten, _ = engine.pipeline.rewrite(rule, base)  # type: ignore[arg-type]
    assert isinstance(rewritten, Correlation)
    inputs = []
    for name, r in zip(rewritten.rules, base, strict=True):
        found = engine.queries(r)  # type: ignore[arg-type]
        inputs.append(correlate.Matches(name, [(q.source, q.sql) for q in found], []))
    columns = correlate._columns(rewritten, inputs)
    events = correlate.typed_union(rewritten, inputs, columns).withWatermark(TIME, delay)
    span = f"{rewritten.seconds} seconds"
    window = F.window(TIME, span, f"{slide} seconds") if slide else F.window(TIME, span)
    keys = [columns[g] for g in rewritten.group_by]
    grouped = events.groupBy(window.alias("_window"), *keys)
    if rewritten.expression is not None:
        out = grouped.agg(_any_alternative(rewritten).alias("_value")).where("_value = 1")
    else:
        if rewritten.kind is Kind.TEMPORAL_ORDERED:
            value = _in_order(rewritten.rules).cast("long")
        elif rewritten.kind is Kind.VALUE_COUNT:
            # exact: the set of values is the state; distinct aggregates don't run on streams
            fields = [F.col(columns[f]) for f in rewritten.threshold.fields]  # type: ignore[union-attr]
            value = F.size(F.collect_set(fields[0] if len(fields) == 1 else F.struct(*fields))).cast("long")
        else:
            value = correlate._measure(rewritten, columns, None)
        threshold = rewritten.threshold
        assert threshold is not None
        out = grouped.agg(value.alias("_value")).where(f"_value {OPERATORS[threshold.operator]} {threshold.value!r}")
    named = [F.col(columns[g]).alias(g) for g in rewritten.group_by]
    return out.select(*named, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("ts"), F.col("_value").alias("value"))


def _any_alternative(rule: Correlation) -> Column:
    """1 if an alternative of the condition holds in the window, else 0."""
    ordered = rule.kind is Kind.EXTENDED_TEMPORAL_ORDERED
    fires = F.lit(False)
    for present, absent in correlate.alternatives(rule.expression):
        if not present:
            raise PlanError("an alternative of the correlation condition wants no event")
        test = _in_order(present) == len(present) if ordered else F.lit(True)
        for n in present:
            test = test & F.max(F.col(RULE) == n)
        for n in absent:
            test = test & ~F.max(F.col(RULE) == n)
        fires = fires | test
    return F.when(fires, F.lit(1)).otherwise(F.lit(0)).cast("long")


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise PlanError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vigil-")
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_once(df: DataFrame) -> DataFrame:
    """Run a streaming plan over what its sources hold now, and return what it has appended."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    write(df, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def write(df: DataFrame, path: str, checkpoint: str, format: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append results to files, exactly once; ``once`` stops when what is there has been read."""
    writer = df.writeStream.format(format).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
