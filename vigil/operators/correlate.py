"""Correlations: typed union of matches, windows over them, and thresholds.

Sliding windows look back from each event over the time span. To keep a group, or
all events where there is no group, from being one sort in one task, time is cut into
stretches of several spans; each stretch also sees the last span before it, as rows
that count but do not report. A hot group is thereby as many tasks as it has stretches.

Within a stretch the work grows with the events, not with events times window, for all
but percentiles and carried fields: counts, also of distinct values, are running sums of
events that begin and end; sums and averages add what a span's block has so far and what
the block before it has left, without taking anything off; rules are seen by the time of
their latest event.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigil.errors import PlanError
from vigil.plans.compile import quote, quote_name
from vigil.plans.condition import And, Name, Not, Or
from vigil.plans.correlation import OPERATORS, Correlation, Kind
from vigil.sources.catalog import Source

METHODS = ("sliding", "tumbling")
#: Spans in a stretch of time.
STRETCH = 8
#: Events of a group in a stretch up to which each sliding sum is added anew, in order of time.
IN_ORDER = 256
RULE, TIME = "_rule", "_ts"


@dataclass
class Matches:
    """What one referenced rule contributes: predicates on sources, or a frame with a time."""

    name: str
    parts: list[tuple[Source, str]] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    frame: DataFrame | None = None


def nested(name: str, frame: DataFrame) -> Matches:
    """The result of a correlation as input of another: an event at the end of each of its windows."""
    return Matches(name, [], [], frame)


def _columns(rule: Correlation, inputs: list[Matches]) -> dict[str, str]:
    """Output columns by the name that the correlation uses: keys, measured and carried fields."""
    names = list(rule.group_by)
    names += [f for f in (rule.threshold.fields if rule.threshold else ()) if f not in names]
    for m in inputs:
        names += [f for f in m.fields if f not in names]
    return {n: f"_c{i}" for i, n in enumerate(names)}


def typed_union(rule: Correlation, inputs: list[Matches], columns: dict[str, str]) -> DataFrame:
    """A row for each match: rule, time, and the columns, with aliases resolved.

    Rules on the same source share one scan.
    """
    scans: dict[int, tuple[Source, list[tuple[str, str]]]] = {}
    for m in inputs:
        for source, sql in m.parts:
            scans.setdefault(id(source), (source, []))[1].append((m.name, sql))
    out: list[tuple[DataFrame, dict[str, str]]] = []
    for source, rules in scans.values():
        out.append(_scan(rule, source, rules, columns))
    for m in inputs:
        if m.frame is not None:
            known = set(m.frame.columns)
            types = dict(m.frame.dtypes)
            select = [F.lit(m.name).alias(RULE), F.col("ts").alias(TIME)]
            kinds = {}
            for name, c in columns.items():
                actual = rule.aliases.get(name, {}).get(m.name, name)
                kinds[c] = types.get(actual, "void")
                select.append((F.col(quote_name(actual)) if actual in known else F.lit(None)).alias(c))
            out.append((m.frame.select(*select), kinds))
    # where sources differ in type, values meet as text
    final: dict[str, str] = {}
    for c in columns.values():
        kinds = {k[c] for _, k in out} - {"void"}
        final[c] = kinds.pop() if len(kinds) == 1 else "string"
    union = None
    for frame, _ in out:
        frame = frame.select(RULE, F.col(TIME).cast("timestamp").alias(TIME), *[F.col(c).cast(t).alias(c) for c, t in final.items()])
        union = frame if union is None else union.unionByName(frame)
    if union is None:
        raise PlanError("the correlation refers to no rule")
    return union


def _scan(rule: Correlation, source: Source, rules: list[tuple[str, str]], columns: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    if source.time is None:
        raise PlanError(f"source {source.name or source.logsource} has no time column")
    frame, fields = source.frame, source.fields
    if len(rules) == 1:
        tagged = frame.where(rules[0][1]).selectExpr("*", f"{quote(rules[0][0])} AS {RULE}")
    else:
        # a rule of several conditions is met once; each predicate is evaluated once
        named: dict[str, list[str]] = {}
        for name, sql in rules:
            named.setdefault(name, []).append(sql)
        tags = ", ".join(f"IF({' OR '.join(f'({sql})' for sql in found)}, {quote(name)}, '')" for name, found in named.items())
        tagged = frame.selectExpr("*", f"array_remove(array({tags}), '') AS {RULE}").withColumn(RULE, F.explode_outer(RULE)).where(f"{RULE} IS NOT NULL")
    select = [RULE, f"CAST({quote_name(source.time)} AS TIMESTAMP) AS {TIME}"]
    kinds: dict[str, str] = {}
    for name, c in columns.items():
        by_rule = {r: fields.find(rule.aliases.get(name, {}).get(r, name)) for r, _ in rules}
        types = {ref.kind.simpleString() for ref in by_rule.values() if ref}
        kinds[c] = types.pop() if len(types) == 1 else "string" if types else "void"
        distinct = {ref.sql if ref else None for ref in by_rule.values()}
        cast = (lambda sql: f"CAST({sql} AS STRING)") if kinds[c] == "string" else (lambda sql: sql)
        if len(distinct) == 1:
            sql = distinct.pop()
            text = cast(sql) if sql else "NULL"
        else:
            whens = " ".join(f"WHEN {quote(r)} THEN {cast(ref.sql) if ref else 'NULL'}" for r, ref in by_rule.items())
            text = f"CASE {RULE} {whens} END"
        select.append(f"{text} AS {c}")
    return tagged.selectExpr(*select), kinds


def _micros(span: int) -> int:
    return span * 1_000_000


def _number(rule: Correlation, columns: dict[str, str]) -> Column:
    measured = [F.col(columns[f]) for f in rule.threshold.fields]  # type: ignore[union-attr]
    return F.coalesce(*measured).try_cast("double") if len(measured) > 1 else measured[0].try_cast("double")


def _measure(rule: Correlation, columns: dict[str, str], over: WindowSpec | None) -> Column:
    """The value that the threshold is compared with, as a grouped or a window aggregate."""
    kind, threshold = rule.kind, rule.threshold
    wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    if kind is Kind.EVENT_COUNT:
        return wrap(F.count(F.lit(1)))
    if kind is Kind.TEMPORAL:
        return F.size(wrap(F.collect_set(RULE))).cast("long")
    assert threshold is not None
    measured = [F.col(columns[f]) for f in threshold.fields]
    if kind is Kind.VALUE_COUNT:
        one = measured[0] if len(measured) == 1 else F.when(F.coalesce(*measured).isNotNull(), F.struct(*measured))
        return F.countDistinct(one) if over is None else F.size(wrap(F.collect_set(one))).cast("long")
    number = _number(rule, columns)
    if kind is Kind.VALUE_SUM:
        return wrap(F.sum(number))
    if kind is Kind.VALUE_AVG:
        return wrap(F.avg(number))
    share = 0.5 if kind is Kind.VALUE_MEDIAN else (threshold.percentile or 0.0) / 100
    return wrap(F.percentile(number, F.lit(share)))


def _counted(rule: Correlation, cut: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``_value``: events, or distinct values, in the span up to each own event.

    An event counts from its time until the span is over, or, where values are counted,
    until the next event with its value, so that each value counts by its latest event.
    """
    micros = F.unix_micros(TIME)
    until = micros + _micros(rule.seconds) + 1
    counts = F.lit(True)
    if rule.kind is Kind.VALUE_COUNT:
        measured = [F.col(columns[f]) for f in rule.threshold.fields]  # type: ignore[union-attr]
        one = measured[0] if len(measured) == 1 else F.when(F.coalesce(*measured).isNotNull(), F.struct(*measured))
        cut = cut.repartition(*keys, "_stretch").withColumn("_one", one)
        counts = F.col("_one").isNotNull()
        until = F.least(F.lead(micros).over(Window.partitionBy(*keys, "_stretch", "_one").orderBy(micros)), until)
    begin = F.struct(micros.alias("at"), counts.cast("int").alias("step"), F.col("_own").alias("own"))
    end = F.struct(until.alias("at"), (-counts.cast("int")).alias("step"), F.lit(False).alias("own"))
    steps = cut.withColumn("_until", end).withColumn("_step", F.explode(F.array(begin, F.col("_until"))))
    over = Window.partitionBy(*keys, "_stretch").orderBy("_step.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("_value", F.sum("_step.step").over(over)).withColumn("_own", F.col("_step.own"))


def _summed(rule: Correlation, cut: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``_value``: the sum or average of the span up to each own event.

    Time is cut into blocks as long as the span. The span up to an event is the beginning
    of its block and the end of the block before; the latter's sums from each event on are
    sent one span later, where the first that isn't before the event has what is wanted.
    Stretches of few events are added anew for each, in order; in others each row is alone there.
    """
    number = _number(rule, columns)
    span, micros = _micros(rule.seconds), F.unix_micros(TIME)
    parts = [*keys, "_stretch", "_block"]
    rows = cut.repartition(*keys, "_stretch").withColumn("_number", number).withColumn("_at", micros).withColumn("_block", F.floor(F.col("_at") / span))
    stretch = Window.partitionBy(*keys, "_stretch")
    rows = rows.withColumn("_few", F.count(F.lit(1)).over(stretch) <= IN_ORDER).withColumn("_alone", F.row_number().over(stretch.orderBy("_at")))
    anew = Window.partitionBy(*keys, "_stretch", "_alone").orderBy("_at").rangeBetween(-span, 0)
    rows = rows.withColumn("_alone", F.when(F.col("_few"), 0).otherwise(F.col("_alone"))).withColumn("_anew", F.sum("_number").over(anew))
    whole = (Window.unboundedPreceding, Window.currentRow)

    def so_far(order: Column) -> Column:
        over = Window.partitionBy(*parts).orderBy(order).rangeBetween(*whole)
        return F.struct(F.sum("_number").over(over).alias("sum"), F.count("_number").over(over).alias("n"))

    rows = rows.withColumn("_head", so_far(F.col("_at").asc())).withColumn("_tail", so_far(F.col("_at").desc()))
    none = F.lit(None).cast("struct<sum:double,n:bigint>")
    here = F.struct(F.col("_block").alias("block"), F.col("_at").alias("at"), F.col("_own").alias("own"), none.alias("tail"))
    later = F.struct((F.col("_block") + 1).alias("block"), (F.col("_at") + span).alias("at"), F.lit(False).alias("own"), F.col("_tail").alias("tail"))
    sent = rows.withColumn("_sent", F.explode(F.array(here, later))).withColumn("_own", F.col("_sent.own")).withColumn("_block", F.col("_sent.block"))
    over = Window.partitionBy(*parts).orderBy(F.col("_sent.at").desc()).rangeBetween(*whole)
    out = sent.withColumn("_before", F.last("_sent.tail", ignorenulls=True).over(over)).where("_own")
    n = F.col("_head.n") + F.coalesce(F.col("_before.n"), F.lit(0))
    both = F.when(F.col("_few"), F.col("_anew")).otherwise(F.coalesce(F.col("_before.sum"), F.lit(0.0)) + F.coalesce(F.col("_head.sum"), F.lit(0.0)))
    return out.withColumn("_value", F.when(n > 0, both if rule.kind is Kind.VALUE_SUM else both / n))


def _met(rules: list[str], out: DataFrame, spec: WindowSpec, span: int) -> DataFrame:
    """``_has<i>``: whether an event of the i-th rule is in the span up to the row, by the time of its latest one."""
    micros = F.unix_micros(TIME)
    over = spec.orderBy(micros).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for i, r in enumerate(rules):
        latest = F.max(F.when(F.col(RULE) == r, micros)).over(over)
        out = out.withColumn(f"_has{i}", F.coalesce(latest >= micros - _micros(span), F.lit(False)))
    return out


def _carried(rule: Correlation, inputs: list[Matches], columns: dict[str, str]) -> dict[str, str]:
    names = {f for m in inputs for f in m.fields}
    return {n: c for n, c in columns.items() if n in names and n not in rule.group_by}


def _named(rule: Correlation, columns: dict[str, str]) -> list[Column]:
    return [F.col(columns[g]).alias(g) for g in rule.group_by]


def plan(rule: Correlation, inputs: list[Matches], method: str = "sliding") -> DataFrame:
    """The groups in which the correlation holds."""
    columns = _columns(rule, inputs)
    events = typed_union(rule, inputs, columns).where(F.col(TIME).isNotNull())
    carried = _carried(rule, inputs, columns)
    return {"tumbling": tumbling, "sliding": sliding}[method](rule, events, columns, carried)


def tumbling(rule: Correlation, events: DataFrame, columns: dict[str, str], carried: dict[str, str]) -> DataFrame:
    """One row for each span of time and group: keys, ``window_start``, ``ts`` (its end), ``value``, fields."""
    keys = [columns[g] for g in rule.group_by]
    window = F.window(TIME, f"{rule.seconds} seconds").alias("_window")
    if "ordered" in rule.kind.value or rule.expression is not None:
        spec = Window.partitionBy("_start", *keys)
        start = F.timestamp_micros(F.floor(F.unix_micros(TIME) / _micros(rule.seconds)) * _micros(rule.seconds))
        cut = events.withColumn("_start", start)
        if rule.expression is not None:
            fires = _expression(rule, cut, spec)
            found = fires.where("_fires").groupBy("_start", *keys).agg(F.lit(1).cast("long").alias("_value"))
        else:
            chained = _chains(rule.rules, cut, spec, rule.seconds)
            found = chained.groupBy("_start", *keys).agg(F.max("_length").cast("long").alias("_value"))
            found = found.where(f"_value {OPERATORS[rule.threshold.operator]} {rule.threshold.value!r}")  # type: ignore[union-attr]
        end = F.timestamp_micros(F.unix_micros("_start") + _micros(rule.seconds))
        return found.select(*_named(rule, columns), F.col("_start").alias("window_start"), end.alias("ts"), F.col("_value").alias("value"))
    if rule.kind in (Kind.VALUE_SUM, Kind.VALUE_AVG):
        spec = Window.partitionBy("_window", *keys).orderBy(TIME, "_number")
        whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cut = events.withColumn("_window", window).withColumn("_number", _number(rule, columns))
        sets = {c + "_set": F.array_sort(F.collect_set(c).over(whole)) for c in carried.values()}
        grouped = cut.withColumns({"_value": _measure(rule, columns, whole), **sets, "_first": F.row_number().over(spec)}).where("_first = 1")
    else:
        extra = [F.array_sort(F.collect_set(c)).alias(c + "_set") for c in carried.values()]
        grouped = events.groupBy(window, *keys).agg(_measure(rule, columns, None).alias("_value"), *extra)
    grouped = grouped.where(f"_value {OPERATORS[rule.threshold.operator]} {rule.threshold.value!r}")  # type: ignore[union-attr]
    return grouped.select(
        *_named(rule, columns), F.col("_window.start").alias("window_start"), F.col("_window.end").alias("ts"), F.col("_value").alias("value"), *[F.col(c + "_set").alias(n) for n, c in carried.items()]
    )


def _stretched(events: DataFrame, span: int) -> DataFrame:
    """Events by stretch of time; those in the last span of one also stand, silent, in the next."""
    length = _micros(span) * STRETCH
    micros = F.unix_micros(TIME)
    here = F.floor(micros / length).cast("long")
    late = micros + _micros(span) >= (here + 1) * length
    own, next_ = F.struct(here.alias("stretch"), F.lit(True).alias("own")), F.struct((here + 1).alias("stretch"), F.lit(False).alias("own"))
    out = events.withColumn("_s", F.explode(F.when(late, F.array(own, next_)).otherwise(F.array(own))))
    return out.select(*events.columns, F.col("_s.stretch").alias("_stretch"), F.col("_s.own").alias("_own"))


def sliding(rule: Correlation, events: DataFrame, columns: dict[str, str], carried: dict[str, str]) -> DataFrame:
    """One row for each event at which the span before it satisfies the rule: keys, ``ts``, ``value``, fields."""
    keys = [columns[g] for g in rule.group_by]
    cut = _stretched(events, rule.seconds)
    spec = Window.partitionBy(*keys, "_stretch")
    over = spec.orderBy(F.unix_micros(TIME)).rangeBetween(-_micros(rule.seconds), 0)
    for c in carried.values():
        cut = cut.withColumn(c + "_set", F.array_sort(F.collect_set(c).over(over)))
    if rule.expression is not None:
        found = _expression(rule, cut, spec, sliding=True).where("_fires").withColumn("_value", F.lit(1).cast("long"))
    elif rule.kind is Kind.TEMPORAL_ORDERED:
        found = _chains(rule.rules, cut, spec, rule.seconds).withColumn("_value", F.col("_length").cast("long"))
        found = found.where("_length > 0")
    elif rule.kind is Kind.TEMPORAL:
        found = _met(rule.rules, cut, spec, rule.seconds)
        found = found.withColumn("_value", sum((F.col(f"_has{i}").cast("long") for i in range(1, len(rule.rules))), F.col("_has0").cast("long")))
    elif rule.kind in (Kind.EVENT_COUNT, Kind.VALUE_COUNT):
        found = _counted(rule, cut, keys, columns)
    elif rule.kind in (Kind.VALUE_SUM, Kind.VALUE_AVG):
        found = _summed(rule, cut, keys, columns)
    else:
        found = cut.withColumn("_value", _measure(rule, columns, over))
    found = found.where("_own")
    if rule.expression is None:
        found = found.where(f"_value {OPERATORS[rule.threshold.operator]} {rule.threshold.value!r}")  # type: ignore[union-attr]
    return found.select(*_named(rule, columns), F.col(TIME).alias("ts"), F.col("_value").alias("value"), *[F.col(c + "_set").alias(n) for n, c in carried.items()])


def _chains(rules: list[str], events: DataFrame, spec: WindowSpec, span: int) -> DataFrame:
    """``_length``: the most rules in listed order, each strictly later, of a chain that ends in the row within the span.

    ``_b<j>`` is the latest start of a chain of j rules that ends in the row. Chains of
    j + 1 extend the best chain of j that ended earlier in a rule before this one.
    """
    earlier = spec.orderBy(F.unix_micros(TIME)).rangeBetween(Window.unboundedPreceding, -1)
    micros = F.unix_micros(TIME)
    out = events.withColumn("_b1", micros)
    place = {r: i for i, r in enumerate(rules)}
    for j in range(1, len(rules)):
        best: Column | None = None
        names = []
        for r, i in place.items():
            if j - 1 <= i < len(rules) - 1:
                out = out.withColumn(f"_m{i}", F.max(F.when(F.col(RULE) == r, F.col(f"_b{j}"))).over(earlier))
                names.append((i, f"_m{i}"))
        for r, i in place.items():
            before = [F.col(n) for k, n in names if k < i]
            if before:
                latest = before[0] if len(before) == 1 else F.greatest(*before)
                best = F.when(F.col(RULE) == r, latest) if best is None else best.when(F.col(RULE) == r, latest)
        kept = F.when(micros - best <= _micros(span), best) if best is not None else F.lit(None).cast("long")
        out = out.withColumn(f"_b{j + 1}", kept).drop(*[n for _, n in names])
    length = F.lit(1)
    for j in range(2, len(rules) + 1):
        length = F.when(F.col(f"_b{j}").isNotNull(), j).otherwise(length)
    return out.withColumn("_length", length).drop(*[f"_b{j}" for j in range(1, len(rules) + 1)])


def alternatives(node: object, wanted: bool = True) -> list[tuple[list[str], list[str]]]:
    """Disjunctive normal form: (present in order, absent) of each alternative."""
    match node:
        case Name(n):
            return [([n], [])] if wanted else [([], [n])]
        case Not(arg):
            return alternatives(arg, not wanted)
        case And(args) | Or(args):
            parts = [alternatives(a, wanted) for a in args]
            if isinstance(node, And) != wanted:
                return [x for p in parts for x in p]
            out: list[tuple[list[str], list[str]]] = [([], [])]
            for p in parts:
                out = [(a + [x for x in c if x not in a], b + [x for x in d if x not in b]) for a, b in out for c, d in p]
                if len(out) > 64:
                    raise PlanError("the correlation condition has too many alternatives")
            return [(a, b) for a, b in out if not set(a) & set(b)]
    raise PlanError(f"unknown node {node}")


def _expression(rule: Correlation, events: DataFrame, spec: WindowSpec, sliding: bool = False) -> DataFrame:
    """``_fires``: whether an alternative of the condition holds at the row.

    The row itself must be of a rule that the alternative wants; for ordered rules it
    ends a chain of all of them in the order in which the condition names them.
    """
    ordered = rule.kind is Kind.EXTENDED_TEMPORAL_ORDERED
    out, tests = events, []
    names = sorted({n for a in alternatives(rule.expression) for x in a for n in x})
    if sliding:
        out = _met(names, out, spec, rule.seconds)
    else:
        for i, n in enumerate(names):
            out = out.withColumn(f"_has{i}", F.coalesce(F.max(F.col(RULE) == n).over(spec), F.lit(False)))
    has = {n: F.col(f"_has{i}") for i, n in enumerate(names)}
    for k, (present, absent) in enumerate(alternatives(rule.expression)):
        if not present:
            raise PlanError("an alternative of the correlation condition wants no event; it needs one to report")
        test = F.col(RULE).isin(present)
        if ordered and len(present) > 1:
            out = _chains(present, out, spec, rule.seconds).withColumnRenamed("_length", f"_len{k}")
            test = (F.col(RULE) == present[-1]) & (F.col(f"_len{k}") == len(present))
        for n in present:
            test = test & has[n]
        for n in absent:
            test = test & ~has[n]
        tests.append(test)
    fires = tests[0]
    for t in tests[1:]:
        fires = fires | t
    helpers = [f"_has{i}" for i in range(len(names))] + [f"_len{k}" for k in range(len(tests))]
    return out.withColumn("_fires", fires).drop(*helpers)
