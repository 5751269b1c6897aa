import pytest

from vigil.errors import ConditionError, ReferenceError_, RuleError
from vigil.plans.condition import And, Name, Not, Or, Selector, parse
from vigil.plans.correlation import Correlation, Kind, seconds
from vigil.plans.rules import Leaf, Level, LogSource, Rule
from vigil.functions.values import Text
from vigil.plans.validate import Validator, names
from vigil.sources.rules import Collection

RULE = """
title: A rule
id: 5013198f-10b1-4d4c-8dc1-0f1b3e3a7a3b
name: a_rule
status: test
level: high
tags: [attack.t1059, cve.2024-1]
date: 2024/1/2
fields: [a]
custom: x
logsource: {category: c, product: p}
detection:
  sel: {a: x, b|contains: [y, z]}
  condition: sel
"""


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a and b or c", Or((And((Name("a"), Name("b"))), Name("c")))),
        ("not a and not (b or c)", And((Not(Name("a")), Not(Or((Name("b"), Name("c"))))))),
        ("1 of sel_* and all of them", And((Selector(False, "sel_*"), Selector(True, None)))),
        ("notepad or android", Or((Name("notepad"), Name("android")))),
        ("any of them", Selector(False, None)),
    ],
)
def test_conditions(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "a and", "(a", "a b", "a | count() > 5", "and a", "1 of", "a $ b"])
def test_bad_conditions(text):
    with pytest.raises(ConditionError):
        parse(text)


def test_rule_round_trip():
    rule = Rule.from_yaml(RULE)
    assert rule.meta.level is Level.HIGH and Level.HIGH > Level.LOW and rule.meta.custom == {"custom": "x"}
    again = Rule.from_dict(rule.to_dict())
    assert again.to_dict() == rule.to_dict() and again.trees() == rule.trees()
    assert str(rule.meta.date) == "2024-01-02"


def test_trees():
    def tree(detection):
        return Rule.from_dict({"title": "t", "logsource": {"category": "c"}, "detection": detection}).trees()[0]

    a, b = Leaf("a", Text.parse("x")), Leaf("b", Text.parse("y"))
    assert tree({"s": {"a": "x", "b": "y"}, "condition": "s"}) == And((a, b))
    assert tree({"s": [{"a": "x"}, {"b": "y"}], "condition": "s"}) == Or((a, b))
    assert tree({"s": {"a|neq": "x"}, "condition": "s"}) == Not(a)
    assert tree({"s": ["x"], "condition": "not s"}) == Not(Leaf(None, Text.parse("x")))
    assert tree({"s1": {"a": "x"}, "_s2": {"b": "y"}, "condition": "all of them"}) == a
    assert tree({"s1": {"a": "x"}, "_s2": {"b": "y"}, "condition": "1 of _*"}) == b
    with pytest.raises(ConditionError):
        tree({"s": {"a": "x"}, "condition": "other"})


@pytest.mark.parametrize(
    "change",
    [{"title": None}, {"id": "x"}, {"level": "huge"}, {"status": 1}, {"tags": ["bad"]}, {"date": "yesterday"}, {"logsource": None}, {"logsource": {"other": 1}}, {"detection": {"condition": "a"}}, {"detection": {"a": {"b": 1}}}, {"detection": {"a": {"b|nope": 1}, "condition": "a"}}, {"detection": {"a": {}, "condition": "a"}}],
)
def test_bad_rules(change):
    data = {"title": "t", "logsource": {"category": "c"}, "detection": {"a": {"b": 1}, "condition": "a"}} | change
    with pytest.raises(RuleError):
        Rule.from_dict(data)
    assert Rule.from_dict(data, collect_errors=True).errors


def test_duplicate_keys_are_refused():
    with pytest.raises(RuleError):
        Collection.from_yaml("title: a\ntitle: b\nlogsource: {category: c}\ndetection: {a: {b: 1}, condition: a}\n")


def test_log_sources():
    wide, narrow = LogSource("c"), LogSource("c", "p")
    assert narrow in wide and wide not in narrow and wide in wide


def test_actions_and_lookup(tmp_path):
    text = "action: global\nlogsource: {category: c}\ndetection: {condition: s}\n---\ntitle: a\nname: one\ndetection: {s: {x: 1}}\n---\naction: repeat\ntitle: b\nname: two\ndetection: {s: {y: 2}}\n---\naction: reset\n---\n" + RULE.lstrip()
    found = Collection.from_yaml(text)
    assert [r.title for r in found] == ["a", "b", "A rule"] and len(found) == 3
    assert {i.field for i in found["two"].each_item()} == {"x", "y"}
    assert found["5013198f-10b1-4d4c-8dc1-0f1b3e3a7a3b"].title == "A rule"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.yml").write_text(RULE)
    loaded = Collection.load([tmp_path], after=lambda p, c: c)
    assert len(loaded) == 1 and loaded[0].source.name == "r.yml"
    assert len(Collection.load([tmp_path], before=lambda p: None)) == 0
    with pytest.raises(RuleError):
        Collection.load([tmp_path / "none"])
    bad = Collection.from_yaml("title: t\n---\n- x\n", collect_errors=True)
    assert len(bad.errors) >= 2


def correlation(**more):
    data = {"type": "event_count", "rules": ["a_rule"], "timespan": "5m", "condition": {"gte": 2}} | more
    return {"title": "c", "name": "c", "correlation": {k: v for k, v in data.items() if v is not None}}


def test_correlations_parse_and_resolve():
    found = Collection.from_dicts([correlation(), Rule.from_yaml(RULE).to_dict()])
    assert [r.title for r in found] == ["A rule", "c"] and [r.title for r in found.output_rules()] == ["c"]
    assert [r.title for r in found.unreferenced_rules()] == ["c"]
    keeps = Collection.from_dicts([correlation(generate=True), Rule.from_yaml(RULE).to_dict()])
    assert len(keeps.output_rules()) == 2
    c = Correlation.from_dict(correlation(type="temporal", condition=None, rules=["a", "b"]))
    assert c.threshold.value == 2 and c.kind is Kind.TEMPORAL
    e = Correlation.from_dict(correlation(type="temporal_ordered", condition="b and not a", rules=None))
    assert e.rules == ["b", "a"] and e.kind is Kind.EXTENDED_TEMPORAL_ORDERED
    again = Correlation.from_dict(e.to_dict())
    assert again.expression == e.expression
    assert Correlation.from_dict(correlation(type="value_avg", condition={"lt": 0.5, "field": "f"})).threshold.value == 0.5
    with pytest.raises(ReferenceError_):
        Collection.from_dicts([correlation()])
    a, b = correlation(rules=["y"]) | {"name": "x"}, correlation(rules=["x"]) | {"name": "y"}
    with pytest.raises(ReferenceError_):
        Collection.from_dicts([a, b])


@pytest.mark.parametrize("change", [{"type": "x"}, {"rules": None}, {"timespan": "5"}, {"timespan": None}, {"condition": None}, {"condition": {"gte": 1, "lt": 2}}, {"condition": {"gte": "x"}}, {"type": "value_count"}, {"type": "value_percentile", "condition": {"gte": 1, "field": "f"}}, {"aliases": {"a": 1}}, {"condition": "a and b"}, {"type": "temporal", "condition": "a and zz", "rules": ["a"]}])
def test_bad_correlations(change):
    with pytest.raises(RuleError):
        Correlation.from_dict(correlation(**change))


def test_time_spans():
    assert [seconds(x) for x in ("2s", "3m", "1h", "1d", "1w", "1M", "1y")] == [2, 180, 3600, 86400, 604800, 2629746, 31556952]


def test_filters_apply_to_their_rules():
    f = "---\ntitle: f\nlogsource: {category: c}\nfilter:\n  rules: any\n  x1: {a: q}\n  x2: {a: r}\n  condition: not 1 of x*\n"
    with_filter = Collection.from_yaml(RULE + f)[0]
    without = Collection.from_yaml(RULE)[0]
    assert with_filter.trees()[0] == And((without.trees()[0], Not(Or((Leaf("a", Text.parse("q")), Leaf("a", Text.parse("r")))))))
    other = Collection.from_yaml(RULE + f.replace("category: c", "category: d"))[0]
    named = Collection.from_yaml(RULE + f.replace("any", "[nobody]"))[0]
    assert other.trees() == named.trees() == without.trees()
    with pytest.raises(RuleError):
        Collection.from_yaml(RULE + f.replace("  rules: any\n", ""))


BAD = """
title: Bad
references: [x, x]
tags: [attack.t1, attack.t1, Bad.x, cve.x, tlp.pink, stp.9, odd.x]
falsepositive: [x]
logsource: {product: windows, service: sysmon, kind: x}
detection:
  sel: {EventID: 1, a: '**x', b: '*y*', c: 'z*', d: '12', e|all: [p, q], f|base64offset: s, g: "t\\tu", h: 'v\\*'}
  unused: {a: b}
  condition: sel and 1 of missing*
"""


def test_checks():
    found = {i.check for i in Validator().validate(Collection.from_yaml(BAD))}
    assert found >= {
        "dangling_detection", "dangling_condition", "specific_instead_of_generic_logsource", "fieldname_logsource", "identifier_existence", "duplicate_references", "custom_attributes", "invalid_modifier_combinations",
        "tag_format", "namespace_tag", "cve_tag", "stp_tag", "tlp_tag", "duplicate_tag", "double_wildcard", "wildcards_instead_of_modifiers", "number_as_string", "control_character", "escaped_wildcard",
    }
    assert not Validator().validate(Collection.from_yaml(RULE))
    twice = Collection.from_yaml(RULE + "---" + RULE)
    assert {i.check for i in Validator().validate(twice)} == {"identifier_uniqueness", "duplicate_title"}
    chosen = Validator.from_dict({"validators": ["all", "-duplicate_title"], "exclusions": {"5013198f-10b1-4d4c-8dc1-0f1b3e3a7a3b": "identifier_uniqueness"}, "config": {"attack_tag": {"vocabulary": ["t1"]}}})
    assert {i.check for i in chosen.validate(twice)} == {"attack_tag"} and len(names()) == 31
    them = Collection.from_yaml(RULE.replace("condition: sel", "condition: all of them"))
    assert {i.check for i in Validator().validate(them)} == {"them_condition_with_single_detection", "all_of_them_condition"}
