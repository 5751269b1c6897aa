"""Running rules: filters, fused scans of many rules, and correlations, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.errors import PlanError, VigilError
from vigil.operators import correlate
from vigil.plans.compile import Compiler, quote, quote_name, register
from vigil.plans.correlation import Correlation
from vigil.plans.pipeline import Pipeline, State
from vigil.plans.rules import AnyRule, Rule
from vigil.sources.catalog import Catalog, Source
from vigil.sources.rules import Collection

#: Rules of one scan whose predicates go into one projection.
CHUNK = 2000
#: Bytes of a generated method beyond which the JVM only interprets it; Spark then compiles operators apart, in small methods.
METHOD_LIMIT = 8000


@dataclass
class Query:
    """One condition of a rule, compiled for its source."""

    rule: Rule
    index: int
    source: Source
    sql: str
    state: State
    needed: str | None = None  # a weaker predicate that a scan can use, if there is one

    def frame(self) -> DataFrame:
        return self.source.frame.where(self.sql)

    def projected(self) -> DataFrame:
        """The matches, with just the fields that the rule asks for, if it does."""
        out = self.frame()
        wanted = self.rule.meta.fields
        if not wanted:
            return out
        columns = []
        for name in wanted:
            ref = self.source.fields.find(name)
            columns.append(f"{ref.sql if ref else 'CAST(NULL AS STRING)'} AS {quote_name(name)}")
        return out.selectExpr(*columns)

    def text(self) -> str:
        wanted = ", ".join(map(quote_name, self.rule.meta.fields)) or "*"
        return f"SELECT {wanted} FROM {quote_name(self.source.name or str(self.source.logsource))} WHERE {self.sql}"


Callback = Callable[[AnyRule, str, int, object], object]


@dataclass
class Engine:
    """Plans rules against a catalog.

    ``method`` is how correlations see time: ``sliding`` judges each event by the
    time span before it, ``tumbling`` cuts time into spans.
    """

    spark: SparkSession
    catalog: Catalog
    pipeline: Pipeline = field(default_factory=Pipeline)
    method: str = "sliding"
    collect_errors: bool = False
    errors: list[tuple[AnyRule, VigilError]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.method not in correlate.METHODS:
            raise PlanError(f"unknown correlation method {self.method!r}")
        register(self.spark)
        if int(self.spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) > METHOD_LIMIT:
            self.spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)

    # planning

    def queries(self, rule: Rule) -> list[Query]:
        """One for each condition of which something is left."""
        rewritten, state = self.pipeline.rewrite(rule)
        assert isinstance(rewritten, Rule)
        source = self.catalog.find(rewritten.logsource, state.values.get("table"))
        compiler = Compiler(source.fields)
        found = []
        for i, tree in enumerate(rewritten.trees()):
            sql = compiler.sql(tree)
            if sql is not None:
                found.append(Query(rewritten, i, source, sql, state, compiler.needed(tree)))
        return found

    def _guard(self, rule: AnyRule, make: Callable[[], list]) -> list:
        try:
            return make()
        except VigilError as e:
            e.source = e.source or rule.source or rule.title
            if not self.collect_errors:
                raise
            self.errors.append((rule, e))
            return []

    # running

    def matches(self, rule: AnyRule, rules: Collection | None = None) -> list[DataFrame]:
        """The events of a detection rule by condition, or the groups of a correlation rule."""
        if isinstance(rule, Correlation):
            return self._guard(rule, lambda: [self.correlation(rule, rules or Collection([rule], resolve=False))])
        return self._guard(rule, lambda: [q.projected() for q in self.queries(rule)])  # type: ignore[arg-type]

    def run(self, rules: Collection, output_format: str = "dataframe", callback: Callback | None = None) -> object:
        """Results of all rules whose output is wanted, in the given format.

        ``dataframe``: pairs of rule key and DataFrame; ``sql``: query texts after
        post-processing; ``explain``: plans; ``json``: DataFrames of JSON texts;
        ``rows``: collected rows, for small results. The callback may replace a
        result, or drop it by None. The pipeline's finalizers see the texts.
        """
        formats = {"dataframe": self._as_frames, "sql": self._as_sql, "explain": self._as_plans, "json": self._as_json, "rows": self._as_rows}
        if output_format not in formats:
            raise PlanError(f"unknown output format {output_format!r}")
        out = []
        for rule in rules.output_rules():
            for i, (key, result) in enumerate(self._guard(rule, lambda r=rule: formats[output_format](r, rules))):
                result = callback(rule, output_format, i, result) if callback else result
                if result is not None:
                    out.append((key, result) if output_format != "sql" else result)
        return self.pipeline.finalize(out) if output_format == "sql" and self.pipeline.finalizers else out

    def _as_frames(self, rule: AnyRule, rules: Collection) -> list:
        if isinstance(rule, Correlation):
            return [(rule.key, self.correlation(rule, rules))]
        return [(rule.key, q.projected()) for q in self.queries(rule)]  # type: ignore[arg-type]

    def _as_sql(self, rule: AnyRule, rules: Collection) -> list:
        if isinstance(rule, Correlation):
            raise PlanError("correlations have no single query text; use another output format", rule.title)
        return [(rule.key, self.pipeline.postprocess(q.state, q.text())) for q in self.queries(rule)]  # type: ignore[arg-type]

    def _as_plans(self, rule: AnyRule, rules: Collection) -> list:
        return [(k, df._jdf.queryExecution().toString()) for k, df in self._as_frames(rule, rules)]

    def _as_json(self, rule: AnyRule, rules: Collection) -> list:
        return [(k, df.select(F.to_json(F.struct("*")).alias("value"))) for k, df in self._as_frames(rule, rules)]

    def _as_rows(self, rule: AnyRule, rules: Collection) -> list:
        return [(k, df.collect()) for k, df in self._as_frames(rule, rules)]

    # many rules in one scan

    def tagged(self, rules: Iterable[Rule], columns: list[str] | None = None) -> DataFrame:
        """Events of all rules with ``rule_id``, ``rule_title``, ``level`` and ``tags``: a row for each match.

        Rules of one source share its scan. Where each of them needs something that the scan
        can test by itself, the scan skips the rest. One projection then gives each event
        the places of all the rules that it matches; each predicate is evaluated once, and
        one that several rules share once for all.
        """
        by_source: dict[int, list[Query]] = {}
        for rule in rules:
            for q in self._guard(rule, lambda r=rule: self.queries(r)):
                by_source.setdefault(id(q.source), []).append(q)
        if not by_source:
            raise PlanError("no rule gives a query")
        out = None
        for queries in by_source.values():
            for start in range(0, len(queries), CHUNK):
                part = _tag_scan(queries[start : start + CHUNK], columns)
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        assert out is not None
        return out

    # correlations

    def correlation(self, rule: Correlation, rules: Collection, method: str | None = None) -> DataFrame:
        """The groups that a correlation rule finds: its keys, ``ts``, ``value`` and carried fields."""
        targets = [rules[r] for r in rule.rules]
        base = [t for t in targets if isinstance(t, Rule)]
        rewritten, state = self.pipeline.rewrite(rule, base)
        assert isinstance(rewritten, Correlation)
        inputs = []
        for name, target in zip(rewritten.rules, targets, strict=True):
            if isinstance(target, Correlation):
                inputs.append(correlate.nested(name, self.correlation(target, rules, method)))
            else:
                found = self.queries(target)  # type: ignore[arg-type]
                if not found:
                    raise PlanError(f"rule {name!r} gives no query")
                inputs.append(correlate.Matches(name, [(q.source, q.sql) for q in found], found[0].rule.meta.fields))
        return correlate.plan(rewritten, inputs, method or self.method)


def hits(predicates: list[str]) -> str:
    """SQL for the places, from one on, of the predicates that hold."""
    return f"array_remove(array({', '.join(f'IF({p}, {i}, 0)' for i, p in enumerate(predicates, 1))}), 0)"


def scan_filter(frame: DataFrame, needed: list[str | None]) -> DataFrame:
    """The rows that the scan can't rule out, if each alternative needs something that it can test."""
    return frame.where(" OR ".join(dict.fromkeys(f"({n})" for n in needed))) if all(needed) else frame


def _tag_scan(queries: list[Query], columns: list[str] | None) -> DataFrame:
    source = queries[0].source
    names = columns if columns is not None else source.frame.columns
    wanted = [quote_name(c) for c in names]
    tags = []
    for q in queries:
        m = q.rule.meta
        labels = ", ".join(quote(str(t)) for t in m.tags)
        # conditions of one rule are told apart only where there are several
        tags.append(
            f"named_struct('rule_id', {quote(q.rule.key)}, 'rule_title', {quote(m.title)}, "
            f"'level', {quote(m.level.value) if m.level else 'CAST(NULL AS STRING)'}, 'tags', CAST(array({labels}) AS ARRAY<STRING>))"
        )
    place, rule = (_unused(n, names) for n in ("_place", "_rule"))
    scan = scan_filter(source.frame, [q.needed for q in queries])
    # an outer explode, so that no filter on the places comes below it and evaluates them again
    found = scan.selectExpr(*wanted, f"{hits([q.sql for q in queries])} AS {place}").withColumn(place, F.explode_outer(place)).where(f"{place} IS NOT NULL")
    tagged = found.selectExpr(f"element_at(array({', '.join(tags)}), {place}) AS {rule}", *wanted)
    return tagged.selectExpr(f"{rule}.rule_id AS rule_id", f"{rule}.rule_title AS rule_title", f"{rule}.level AS level", f"{rule}.tags AS tags", *wanted)


def _unused(name: str, names: list[str]) -> str:
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name
