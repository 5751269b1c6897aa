"""Rows of small frames, with nulls, case, wildcards, types and time."""

import datetime as dt

import pytest

from vigil.errors import PlanError, SecurityError, TransformationError
from vigil.operators.engine import Engine
from vigil.operators.output import detections
from vigil.plans.compile import quote
from vigil.plans.pipeline import Pipeline, Resolver
from vigil.sources.catalog import Catalog, files
from vigil.sources.rules import Collection
from vigil.streaming.detect import stream_correlation, stream_matches, write

SCHEMA = "id int, a string, b double, c boolean, n_str string, n int, s struct<x:string>, arr array<string>, js string, t timestamp"
T0 = dt.datetime(2024, 1, 1)
ROWS = [
    (1, "Foo", 1.0, True, "10", 10, ("in",), ["p", "q"], '{"k": {"v": "deep"}}', T0),
    (2, "FOO bar", 2.0, False, "abc", 5, ("OUT",), [], '{"k": 3}', T0 + dt.timedelta(hours=5)),
    (3, None, None, None, None, None, None, None, None, None),
    (4, "50%_off~", -1.5, True, "7.5", 7, (None,), [None, "z"], "not json", T0),
    (5, "line\nbreak", 0.0, False, "", 0, ("x",), ["Q"], "{}", T0),
    (6, "it's \\ a", 9.0, True, "1e1", 9, ("y",), ["a*"], '{"k": null}', T0),
]


@pytest.fixture(scope="module")
def engine(spark):
    catalog = Catalog()
    df = spark.createDataFrame(ROWS, SCHEMA)
    catalog.add(df, category="x", name="x", time="t", json_columns=("js",), keyword_columns=("a", "n_str"), derived={"ip": ("concat('10.0.0.', n)", "string")})
    catalog.add(df.where("id < 3"), category="x", product="p")
    return Engine(spark, catalog)


def ids(engine, detection, pipeline=None, **meta):
    data = {"title": "t", "logsource": {"category": "x"}, "detection": detection if "condition" in detection else {"s": detection, "condition": "s"}} | meta
    e = engine if pipeline is None else Engine(engine.spark, engine.catalog, Pipeline.from_dict(pipeline, allow_external=True))
    found = e.matches(Collection.from_dicts([data])[0])
    return sorted(r.id for df in found for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("detection", "wanted"),
    [
        ({"a": "foo"}, [1]),
        ({"a|cased": "foo"}, []),
        ({"a": "foo*"}, [1, 2]),
        ({"a": "*%_*"}, [4]),
        ({"a": "line*break"}, [5]),
        ({"a": "line?break"}, [5]),
        ({"a": "*"}, [1, 2, 4, 5, 6]),
        ({"a": "50%_off~"}, [4]),
        ({"a|contains": "'s \\ "}, [6]),
        ({"a": None}, [3]),
        ({"a|neq": "foo"}, [2, 3, 4, 5, 6]),
        ({"a|neq": ["foo", "foo bar"]}, [3, 4, 5, 6]),
        ({"a|exists": True}, [1, 2, 4, 5, 6]),
        ({"a|exists": False}, [3]),
        ({"zz|exists": True}, []),
        ({"zz": None}, [1, 2, 3, 4, 5, 6]),
        ({"zz": "x"}, []),
        ({"zz|neq": "x"}, [1, 2, 3, 4, 5, 6]),
        ({"A": "FOO"}, [1]),
        ({"n_str": 10}, [1, 6]),
        ({"n": "10"}, [1]),
        ({"n": "1*"}, [1]),
        ({"n_str|lt": 8}, [4]),
        ({"b|lte": 0}, [4, 5]),
        ({"c": True}, [1, 4, 6]),
        ({"s.x": "in"}, [1]),
        ({"arr": "q"}, [1, 5]),
        ({"arr|re": r"^a\*$"}, [6]),
        ({"js.k.v": "deep"}, [1]),
        ({"js.k": 3}, [2]),
        ({"ip|cidr": "10.0.0.8/29"}, [1, 6]),
        ({"t|hour": 5}, [2]),
        ({"a|fieldref": "n_str"}, []),
        ({"n|fieldref": "b"}, [5, 6]),
        ({"a|re": "^foo$"}, []),
        ({"a|re|i": "^foo$"}, [1]),
        ({"a|re": "(?P<x>o)(?P=x)"}, [1]),
        ({"s": ["foo"], "condition": "s"}, [1, 2]),
        ({"s": [10], "condition": "s"}, [1]),
        ({"s": {"a": "foo"}, "condition": "not s"}, [2, 3, 4, 5, 6]),
        ({"s": {"b|gte": 1}, "u": {"c": True}, "condition": "not (s and u)"}, [2, 3, 4, 5]),
        ({"s": {"b|gte": 1}, "condition": "not not s"}, [1, 2, 6]),
    ],
)
def test_rows(engine, detection, wanted):
    assert ids(engine, detection) == wanted


@pytest.mark.parametrize("detection", [{"a": "foo*"}, {"b|gte": 1}, {"a|re": "o"}, {"arr": "q"}, {"js.k": 3}, {"a": None}, {"zz": 1}, {"c": True}])
def test_a_predicate_and_its_negation_cover_all_rows_once(engine, detection):
    yes = ids(engine, {"s": detection, "condition": "s"})
    no = ids(engine, {"s": detection, "condition": "not s"})
    assert sorted(yes + no) == [1, 2, 3, 4, 5, 6]


def test_quoting(spark):
    for text in ("it's", "back\\slash", "\\'", "new\nline", "%_~", "é\t\"", "\\u0041"):
        assert spark.range(1).selectExpr(f"{quote(text)} AS x").first().x == text


def test_most_specific_source_wins(engine):
    data = {"title": "t", "logsource": {"category": "x", "product": "p"}, "detection": {"s": {"a": "*"}, "condition": "s"}}
    assert engine.matches(Collection.from_dicts([data])[0])[0].count() == 2
    with pytest.raises(PlanError):
        ids(engine, {"a": "x"}, logsource={"category": "unknown"})


@pytest.mark.parametrize("detection", [{"s": [True], "condition": "s"}, {"a|re": "(x)(?(1)y|z)"}])
def test_what_has_no_execution_is_refused(engine, detection):
    with pytest.raises(PlanError):
        ids(engine, detection)


def test_pushdown_of_bare_forms(engine, spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/t")
    catalog = Catalog()
    catalog.add(files(spark, f"{tmp_path}/t"), category="x")
    rule = Collection.from_yaml("title: t\nlogsource: {category: x}\nfields: [id]\ndetection: {s: {a|cased: Foo, n|gte: 5}, condition: s}\n")[0]
    plan = Engine(spark, catalog).matches(rule)[0]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,Foo)" in plan and "GreaterThanOrEqual(n,5)" in plan and "ReadSchema: struct<id:int,a:string,n:int>" in plan


def pipe(*items, **more):
    return {"transformations": list(items)} | more


@pytest.mark.parametrize(
    ("detection", "pipeline", "wanted"),
    [
        ({"q": "foo"}, pipe({"type": "field_name_mapping", "mapping": {"q": ["a", "n_str"]}}), [1]),
        ({"q|neq": "foo"}, pipe({"type": "field_name_mapping", "mapping": {"q": ["a", "n_str"]}}), [2, 3, 4, 5, 6]),
        ({"s": ["foo"], "condition": "s"}, pipe({"type": "field_name_mapping", "mapping": {None: "a"}}), [1, 2]),
        ({"a": "foo", "b": 2}, pipe({"type": "drop_detection_item", "detection_item_conditions": [{"type": "match_value", "value": 2}]}), [1]),
        ({"a": "F*"}, pipe({"type": "drop_detection_item", "detection_item_conditions": [{"type": "contains_wildcard", "cond": "any"}]}), []),
        ({"a": "foo", "n": None}, pipe({"type": "drop_detection_item", "detection_item_conditions": [{"type": "is_null", "cond": "all"}]}), [1]),
        ({"a": "xfoo"}, pipe({"type": "replace_string", "regex": "^x", "replacement": "", "detection_item_conditions": [{"type": "match_string", "cond": "any", "pattern": "^x"}]}), [1]),
        ({"a": "foo"}, pipe({"type": "field_name_suffix", "suffix": "_", "id": "one"}, {"type": "field_name_mapping", "mapping": {"a_": "a"}, "field_name_conditions": [{"type": "processing_item_applied", "processing_item_id": "one"}]}), [1]),
        ({"a": "foo"}, pipe({"type": "set_state", "key": "k", "val": 3}, {"type": "add_condition", "conditions": {"b": 5}, "rule_conditions": [{"type": "processing_state", "key": "k", "val": 2, "op": "gt"}]}), []),
        ({"a": "foo"}, pipe({"type": "add_condition", "conditions": {"b": 5}, "rule_conditions": [{"type": "rule_attribute", "attribute": "level", "value": "low", "op": "gte"}]}), [1]),
        ({"a": "foo"}, pipe({"type": "add_condition", "conditions": {"a": "$category*"}, "template": True}), []),
        ({"a|re|expand": "^%p%$"}, pipe({"type": "value_placeholders"}, vars={"p": ["Foo", "it.*a"]}), [1, 6]),
        ({"a": "Foo"}, pipe({"type": "regex", "method": "plain"}), [1]),
        ({"a": "fOO"}, pipe({"type": "regex", "method": "ignore_case_flag"}), [1]),
        ({"b": 1}, pipe({"type": "convert_type", "target_type": "str"}), []),
        ({"a": "foo"}, pipe({"type": "nest", "items": [{"type": "set_value", "value": None}]}), [3]),
        ({"a": "foo"}, pipe({"type": "rule_failure", "message": "m", "rule_conditions": [{"type": "tag", "tag": "x.y"}]}), [1]),
        ({"a": "foo"}, pipe({"type": "set_custom_attribute", "attribute": "k", "value": 1}, {"type": "drop_detection_item", "rule_conditions": [{"type": "is_detection_rule"}, {"type": "is_correlation_rule"}], "rule_cond_op": "or"}, {"type": "add_condition", "conditions": {"a": "foo"}}), [1]),
    ],
)
def test_pipelines(engine, detection, pipeline, wanted):
    if pipeline["transformations"][0]["type"] == "convert_type":
        wanted = ids(engine, {"b": "1"})
    assert ids(engine, detection, pipeline) == wanted


@pytest.mark.parametrize(
    "pipeline",
    [pipe({"type": "rule_failure", "message": "m"}), pipe({"type": "detection_item_failure", "message": "m"}), pipe({"type": "strict_field_mapping_failure"}), pipe({"type": "value_placeholders"}), pipe({"type": "convert_type", "target_type": "num"})],
)
def test_failures(engine, pipeline):
    with pytest.raises(TransformationError):
        ids(engine, {"a|expand": "%p%x"}, pipeline)


def test_external_values(engine, tmp_path):
    (tmp_path / "v.txt").write_text("foo\n\nzzz\n")
    (tmp_path / "v.csv").write_text("n,name\n1,foo\n")
    (tmp_path / "v.json").write_text('{"items": [{"v": "foo"}, {"v": "bar"}]}')
    for more in ({"path": f"{tmp_path}/v.txt", "filter": "^f"}, {"path": f"{tmp_path}/v.csv", "format": "csv", "csv_column": "name"}, {"path": f"{tmp_path}/v.json", "format": "json", "jq_expression": ".items[].v"}):
        assert ids(engine, {"a|expand": "%p%"}, pipe({"type": "file_placeholders"} | more)) == [1]
    assert ids(engine, {"a|expand": "%p%"}, pipe({"type": "command_placeholders", "cmd": ["echo", "foo"]})) == [1]
    closed = Pipeline.from_dict(pipe({"type": "file_placeholders", "path": f"{tmp_path}/v.txt", "allow_external_sources": True}))
    rule = Collection.from_dicts([{"title": "t", "logsource": {"category": "x"}, "detection": {"s": {"a|expand": "%p%"}, "condition": "s"}}])[0]
    with pytest.raises(SecurityError):
        closed.rewrite(rule)


def test_rewriting_leaves_the_rule_alone(engine):
    rule = Collection.from_dicts([{"title": "t", "logsource": {"category": "x"}, "detection": {"s": {"q": "foo"}, "condition": "s"}}])[0]
    before = rule.to_dict()
    e = Engine(engine.spark, engine.catalog, Pipeline.from_dict(pipe({"type": "field_name_mapping", "mapping": {"q": "a"}}, {"type": "add_condition", "conditions": {"b": 1}})))
    assert e.queries(rule)[0].sql == e.queries(rule)[0].sql and rule.to_dict() == before


def test_resolver_orders_by_priority(tmp_path):
    (tmp_path / "b.yml").write_text("name: b\npriority: 20\ntransformations: [{type: field_name_suffix, suffix: _b}]\n")
    (tmp_path / "a.yml").write_text("name: a\npriority: 30\ntransformations: [{type: field_name_suffix, suffix: _a}]\n")
    rule = Collection.from_dicts([{"title": "t", "logsource": {"category": "x"}, "detection": {"s": {"q": 1}, "condition": "s"}}])[0]
    rewritten, state = Resolver().resolve([str(tmp_path)]).rewrite(rule)
    assert [i.field for i in rewritten.each_item()] == ["q_b_a"] and state.mapped == {"q": ["q_b_a"]}


def test_formats_and_finalizers(engine):
    rules = Collection.from_dicts([{"title": "t", "fields": ["id"], "logsource": {"category": "x"}, "detection": {"s": {"a": "foo"}, "condition": "s"}}])
    post = {"postprocessing": [{"type": "embed", "prefix": "[", "suffix": "]"}, {"type": "simple_template", "template": "{rule.title}: {query}"}, {"type": "replace", "pattern": "foo", "replacement": "bar"}], "finalizers": [{"type": "concat", "separator": ";", "prefix": "<"}, {"type": "json"}]}
    e = Engine(engine.spark, engine.catalog, Pipeline.from_dict(post))
    assert e.run(rules, "sql").startswith('"<') and "t: [SELECT `id` FROM `x` WHERE lower(`a`) = 'bar']" in e.run(rules, "sql")
    assert e.run(rules, "rows")[0][1][0].id == 1
    assert "Filter" in e.run(rules, "explain")[0][1]
    assert e.run(rules, "json")[0][1].first().value == '{"id":1}'
    assert e.run(rules, callback=lambda rule, fmt, i, df: None) == []
    with pytest.raises(PlanError):
        e.run(rules, "nothing")


def test_errors_are_collected(engine):
    e = Engine(engine.spark, engine.catalog, collect_errors=True)
    rules = Collection.from_dicts([{"title": str(i), "logsource": {"category": c}, "detection": {"s": {"a": "foo"}, "condition": "s"}} for i, c in enumerate(("x", "none"))])
    assert len(e.run(rules)) == 1 and len(e.errors) == 1


def test_a_rule_with_nothing_left_gives_no_query(engine):
    assert ids(engine, {"a": "foo"}, pipe({"type": "drop_detection_item"})) == []


# correlations

EVENTS = "k int, ts timestamp, type string, v double"
BASE = "\n---\n".join(f"title: {n}\nname: {n}\nlogsource: {{category: e}}\ndetection: {{s: {{type: {n}}}, condition: s}}" for n in "abc") + "\n---\n"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def correlate(spark, rows, body, method="sliding"):
    catalog = Catalog()
    catalog.add(spark.createDataFrame([(k, at(t), n, v) for k, t, n, v in rows], EVENTS), category="e", time="ts")
    rules = Collection.from_yaml(BASE + f"title: corr\nname: corr\ncorrelation: {{{body}}}\n")
    found = Engine(spark, catalog, method=method).matches(rules["corr"], rules)[0]
    return sorted(((r.k, int((r.ts - T0).total_seconds() // 60), r.value) for r in found.collect()), key=str)


ORDERED = "type: temporal_ordered, rules: [a, b, c], timespan: 10m, group-by: [k]"


def test_ordered_sequences(spark):
    rows = [(1, 0, "a", 0.0), (1, 4, "b", 0.0), (1, 10, "c", 0.0), (2, 0, "a", 0.0), (2, 4, "b", 0.0), (2, 11, "c", 0.0), (3, 0, "c", 0.0), (3, 1, "b", 0.0), (3, 2, "a", 0.0), (4, 0, "a", 0.0), (4, 0, "b", 0.0), (4, 1, "c", 0.0), (None, 1, "a", 0.0), (None, 2, "b", 0.0), (None, 3, "c", 0.0)]
    assert correlate(spark, rows, ORDERED) == [(1, 10, 3), (None, 3, 3)]
    two = ORDERED + ", condition: {gte: 2}"
    assert correlate(spark, rows, two) == [(1, 10, 3), (1, 4, 2), (2, 11, 2), (2, 4, 2), (4, 1, 2), (None, 2, 2), (None, 3, 3)]


def test_ordered_takes_the_latest_start(spark):
    rows = [(1, 0, "a", 0.0), (1, 20, "a", 0.0), (1, 21, "b", 0.0), (1, 25, "c", 0.0)]
    assert correlate(spark, rows, ORDERED) == [(1, 25, 3)]


def test_windows_reach_over_stretches(spark):
    # events on both sides of a boundary between stretches of eight spans
    rows = [(1, 79, "a", 1.0), (1, 80, "a", 2.0), (1, 81, "a", 3.0), (1, 200, "a", 4.0)]
    body = "type: value_sum, rules: a, timespan: 10m, group-by: [k], condition: {gte: 0, field: v}"
    assert correlate(spark, rows, body) == [(1, 200, 4.0), (1, 79, 1.0), (1, 80, 3.0), (1, 81, 6.0)]


def test_sums_are_added_in_order_of_time(spark):
    # 0.1 + 0.2 + 0.3 is more than 0.6 in this order only; 10 begins a block
    rows = [(1, 11, "a", 0.3), (1, 10, "a", 0.2), (1, 9, "a", 0.1)]
    assert correlate(spark, rows, "type: value_sum, rules: a, timespan: 10m, group-by: [k], condition: {gt: 0.6, field: v}") == [(1, 11, 0.1 + 0.2 + 0.3)]
    assert correlate(spark, rows, "type: value_avg, rules: a, timespan: 10m, group-by: [k], condition: {gt: 0.2, field: v}") == [(1, 11, (0.1 + 0.2 + 0.3) / 3)]
    rows = [(k, t - 9, n, v) for k, t, n, v in rows]
    assert correlate(spark, rows, "type: value_sum, rules: a, timespan: 10m, group-by: [k], condition: {gt: 0.6, field: v}", "tumbling") == [(1, 10, 0.1 + 0.2 + 0.3)]
    assert correlate(spark, rows, "type: value_avg, rules: a, timespan: 10m, group-by: [k], condition: {gt: 0.2, field: v}", "tumbling") == [(1, 10, (0.1 + 0.2 + 0.3) / 3)]


def test_sums_of_stretches_of_many_events(spark):
    # 300 events of group 1 in a stretch are summed by blocks, and 30 of group 2 in order
    events = [(k, i * step, float(i % 7)) for k, n, step in ((1, 300, 12), (2, 30, 120)) for i in range(n)]
    rows = [(k, t / 60, "a", v) for k, t, v in events]
    want = sorted(((k, t // 60, sum(v2 for k2, t2, v2 in events if k2 == k and t - 600 <= t2 <= t)) for k, t, _ in events), key=str)
    assert correlate(spark, rows, "type: value_sum, rules: a, timespan: 10m, group-by: [k], condition: {gte: 0, field: v}") == want


def test_absence(spark):
    rows = [(1, 0, "b", 0.0), (1, 5, "a", 0.0), (1, 30, "a", 0.0), (2, 0, "a", 0.0), (2, 3, "b", 0.0)]
    assert correlate(spark, rows, 'type: temporal, rules: [a, b], timespan: 10m, group-by: [k], condition: "a and not b"') == [(1, 30, 1), (2, 0, 1)]
    assert correlate(spark, rows, 'type: temporal_ordered, rules: [a, b], timespan: 10m, group-by: [k], condition: "a and b"') == [(2, 3, 1)]


def test_carried_fields_and_nulls(spark):
    catalog = Catalog()
    catalog.add(spark.createDataFrame([(1, at(0), "a", 1.0), (1, at(1), "a", None), (1, None, "a", 9.0)], EVENTS), category="e", time="ts")
    text = BASE.replace("name: a\n", "name: a\nfields: [v, k]\n", 1) + "title: corr\nname: corr\ncorrelation: {type: event_count, rules: a, timespan: 5m, group-by: [k], condition: {gte: 2}}\n"
    rules = Collection.from_yaml(text)
    for method in ("sliding", "tumbling"):
        found = Engine(spark, catalog, method=method).matches(rules["corr"], rules)[0].collect()
        assert [(r.k, r.value, r.v) for r in found] == [(1, 2, [1.0])]


# streams


@pytest.mark.parametrize(
    "body",
    [
        "type: event_count, rules: [a, b], timespan: 10m, group-by: [k], condition: {gte: 2}",
        "type: value_count, rules: [a, b, c], timespan: 10m, group-by: [k], condition: {gte: 2, field: type}",
        "type: value_sum, rules: [a, b], timespan: 10m, group-by: [k], condition: {gt: 1, field: v}",
        "type: value_median, rules: [a, b], timespan: 10m, group-by: [k], condition: {gte: 0, field: v}",
        "type: temporal, rules: [a, b], timespan: 10m, group-by: [k]",
        "type: temporal_ordered, rules: [a, b], timespan: 10m, group-by: [k]",
        'type: temporal, rules: [a, b], timespan: 10m, group-by: [k], condition: "a and not b"',
        'type: temporal_ordered, rules: [a, b], timespan: 10m, group-by: [k], condition: "a and b"',
    ],
)
def test_closed_windows_of_a_stream_equal_the_batch(spark, tmp_path, body):
    rows = [(i % 3, (i * 7) % 97 + (i // 20) * 5, "abc"[i % 3 if i % 4 else 0], float(i % 5)) for i in range(60)]
    df = spark.createDataFrame([(k, at(t), n, v) for k, t, n, v in rows] + [(9, at(100_000), "c", 0.0)], EVENTS)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch, live = Catalog(), Catalog()
    batch.add(df, category="e", time="ts")
    live.add(files(spark, f"{tmp_path}/in", schema=EVENTS, stream=True), category="e", time="ts")
    rules = Collection.from_yaml(BASE.replace("type: c}", "type: [c, zz]}") + f"title: corr\nname: corr\ncorrelation: {{{body}}}\n")
    want = {tuple(r) for r in Engine(spark, batch, method="tumbling").matches(rules["corr"], rules)[0].collect()}
    # a last event far ahead moves the watermark past all windows
    spark.createDataFrame([(9, at(200_000), n, 0.0) for n in "abc"], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = stream_correlation(Engine(spark, live), rules["corr"], rules, "1 minute")
    query = write(out, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {w for w in want if w[0] != 9}


def test_stream_of_matches(spark, tmp_path):
    spark.createDataFrame([(1, at(0), "a", 1.0), (2, at(1), "b", 2.0), (3, at(2), "x", 2.0)], EVENTS).write.parquet(f"{tmp_path}/in")
    live = Catalog()
    live.add(files(spark, f"{tmp_path}/in", schema=EVENTS, stream=True), category="e", time="ts")
    rules = Collection.from_yaml(BASE)
    query = write(stream_matches(Engine(spark, live), list(rules)), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert sorted((r.rule_id, r.k) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1), ("b", 2)]


def test_detections_table(engine):
    rules = Collection.from_dicts([{"title": str(i), "level": "low", "tags": ["attack.t1"], "logsource": {"category": "x"}, "detection": {"s": {"a": a}, "condition": "s"}} for i, a in enumerate(("foo*", "*o*"))])
    rows = detections(engine, rules).collect()
    assert sorted(r.rule_title for r in rows) == ["0", "0", "1", "1", "1"] and rows[0].tags == ["attack.t1"] and '"id":' in rows[0].event


def test_one_scan_of_many_rules_equals_rule_by_rule(engine, monkeypatch):
    from vigil.operators import engine as module

    items = [{"a": "foo*"}, {"b|gte": 1}, {"a": None}, {"n": [5, 7]}, {"a|re": "o"}, {"zz|exists": False}]
    rules = Collection.from_dicts([{"title": f"r{i}", "logsource": {"category": "x"}, "detection": {"s": d, "condition": "s"}} for i, d in enumerate(items)])
    want = sorted((r.title, row.id) for r in rules for df in engine.matches(r) for row in df.collect())
    for chunk in (150, 2):
        monkeypatch.setattr(module, "CHUNK", chunk)
        assert sorted((r.rule_title, r.id) for r in engine.tagged(list(rules)).collect()) == want


@pytest.mark.parametrize(
    "data",
    [
        {"transformations": [{"type": "nope"}]},
        {"transformations": [{"mapping": {}}]},
        {"transformations": [{"type": "field_name_mapping"}]},
        {"transformations": [{"type": "drop_detection_item", "rule_conditions": [{"type": "nope"}]}]},
        {"transformations": [{"type": "drop_detection_item", "rule_conditions": {"a": {"type": "tag", "tag": "x.y"}}}]},
        {"transformations": [{"type": "drop_detection_item", "rule_conditions": {"a": {"type": "tag", "tag": "x.y"}}, "rule_cond_expr": "a and b"}]},
        {"transformations": [{"type": "drop_detection_item", "rule_cond_op": "xor"}]},
        {"transformations": [{"type": "regex", "method": "x"}]},
        {"transformations": [{"type": "replace_string", "regex": "(", "replacement": ""}]},
        {"postprocessing": [{"type": "json", "json_template": "{"}]},
        {"finalizers": [{"type": "nope"}]},
        {"unknown": 1},
        {"priority": "x"},
    ],
)
def test_bad_pipelines(data):
    from vigil.errors import PipelineError

    with pytest.raises(PipelineError):
        Pipeline.from_dict(data)


@pytest.mark.parametrize(
    ("value", "op", "wanted"),
    [("high", "eq", True), ("low", "gt", True), ("high", "lt", False), (["high", "low"], "in", True), ("high", "ne", False)],
)
def test_attribute_conditions(value, op, wanted):
    from vigil.plans.pipeline.conditions import Attribute
    from vigil.plans.pipeline.state import State

    rule = Collection.from_dicts([{"title": "t", "level": "high", "date": "2024-01-02", "score": 5, "logsource": {"category": "x"}, "detection": {"s": {"a": 1}, "condition": "s"}}])[0]
    assert Attribute("level", value, op).rule(State(rule)) == wanted
    assert Attribute("date", "2024-01-01", "gte").rule(State(rule)) and Attribute("score", 4, "gt").rule(State(rule))
    assert Attribute("title", "x", "not_in").rule(State(rule)) and not Attribute("author", "x").rule(State(rule))
