"""Conditions of processing items: on rules, detection items and field names."""

from __future__ import annotations

import datetime
import operator
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from vigil.errors import PipelineError
from vigil.functions.values import Null, Text, Value, from_yaml
from vigil.plans.condition import And, Name, Not, Or, names_of, parse
from vigil.plans.correlation import Correlation
from vigil.plans.pipeline.state import State
from vigil.plans.rules import Item, Level, LogSource, Rule, Status, Tag

_COMPARE = {"eq": operator.eq, "ne": operator.ne, "gte": operator.ge, "gt": operator.gt, "lte": operator.le, "lt": operator.lt}


def _same(value: Value, wanted: object) -> bool:
    other = from_yaml(wanted)
    if isinstance(value, Text) and isinstance(other, Text):
        return value.parts == other.parts
    return value == other


@dataclass
class LogSourceIs:
    category: str | None = None
    product: str | None = None
    service: str | None = None

    def rule(self, state: State) -> bool:
        wanted = LogSource(self.category, self.product, self.service)
        return any(s in wanted for s in state.logsources())


@dataclass
class HasField:
    field: str | None

    def rule(self, state: State) -> bool:
        return any(i.field == self.field for i in state.items())


@dataclass
class HasItem:
    field: str | None
    value: object

    def rule(self, state: State) -> bool:
        return any(i.field == self.field and any(_same(v, self.value) for v in i.values) for i in state.items())


@dataclass
class IsDetectionRule:
    def rule(self, state: State) -> bool:
        return isinstance(state.rule, Rule)


@dataclass
class IsCorrelation:
    def rule(self, state: State) -> bool:
        return isinstance(state.rule, Correlation)


@dataclass
class HasTag:
    tag: str

    def rule(self, state: State) -> bool:
        return Tag.parse(self.tag) in state.rule.meta.tags


@dataclass
class Attribute:
    """A metadata attribute compared with a value of its own kind."""

    attribute: str
    value: object
    op: str = "eq"

    def __post_init__(self) -> None:
        if self.op not in (*_COMPARE, "in", "not_in"):
            raise PipelineError(f"unknown operator {self.op!r}")

    def rule(self, state: State) -> bool:
        meta = state.rule.meta
        found = getattr(meta, self.attribute, None) if self.attribute in meta.KNOWN else meta.custom.get(self.attribute)
        if self.op in ("in", "not_in"):
            if isinstance(self.value, list):
                inside = self._kind(found) in [str(v) for v in self.value]
            else:
                inside = str(self.value) in [str(x) for x in found] if isinstance(found, list) else str(self.value) in str(found)
            return inside == (self.op == "in")
        if found is None:
            return False
        if isinstance(found, list):
            return self.op == "ne" if str(self.value) not in [str(x) for x in found] else self.op == "eq"
        try:
            wanted = self._like(found)
        except ValueError as e:
            raise PipelineError(f"{self.value!r} can't be compared with {self.attribute}") from e
        if isinstance(found, str | uuid.UUID) and self.op not in ("eq", "ne"):
            raise PipelineError(f"{self.attribute} has no order")
        return bool(_COMPARE[self.op](found, wanted))

    @staticmethod
    def _kind(found: object) -> str:
        return str(found.value if isinstance(found, Status | Level) else found)

    def _like(self, found: object) -> object:
        match found:
            case uuid.UUID():
                return uuid.UUID(str(self.value))
            case Status():
                return Status(str(self.value).lower())
            case Level():
                return Level(str(self.value).lower())
            case datetime.date():
                return self.value if isinstance(self.value, datetime.date) else datetime.date.fromisoformat(str(self.value).replace("/", "-"))
            case bool() | int() | float():
                return float(self.value)  # type: ignore[arg-type]
        return str(self.value)


@dataclass
class Applied:
    """Whether a processing item was applied: to the rule, to a detection item, or to a field name."""

    processing_item_id: str

    def rule(self, state: State) -> bool:
        return self.processing_item_id in state.applied

    def item(self, state: State, item: Item) -> bool:
        return self.processing_item_id in item.applied

    def field(self, state: State, name: str | None) -> bool:
        return self.processing_item_id in state.field_applied.get(name, set())


@dataclass
class StateIs:
    key: str
    val: object
    op: str = "eq"

    def __post_init__(self) -> None:
        if self.op not in _COMPARE:
            raise PipelineError(f"unknown operator {self.op!r}")

    def rule(self, state: State) -> bool:
        if self.key not in state.values:
            return False
        try:
            return bool(_COMPARE[self.op](state.values[self.key], self.val))
        except TypeError:
            return False

    def item(self, state: State, item: Item) -> bool:
        return self.rule(state)

    def field(self, state: State, name: str | None) -> bool:
        return self.rule(state)


@dataclass
class _OnValues:
    cond: str = "any"

    def __post_init__(self) -> None:
        if self.cond not in ("any", "all"):
            raise PipelineError("cond must be any or all")

    def item(self, state: State, item: Item) -> bool:
        return (any if self.cond == "any" else all)(self.value(v) for v in item.values)

    def value(self, value: Value) -> bool:
        raise NotImplementedError


@dataclass
class MatchString(_OnValues):
    pattern: str = ""
    negate: bool = False

    def value(self, value: Value) -> bool:
        found = isinstance(value, Text) and re.match(self.pattern, value.plain()) is not None
        return found != self.negate


@dataclass
class MatchValue(_OnValues):
    value_: object = None

    def value(self, value: Value) -> bool:
        return _same(value, self.value_)


@dataclass
class HasWildcard(_OnValues):
    def value(self, value: Value) -> bool:
        return isinstance(value, Text) and value.has_wildcards


@dataclass
class IsNull(_OnValues):
    def value(self, value: Value) -> bool:
        return isinstance(value, Null)


@dataclass
class FieldIn:
    fields: list[str]
    mode: str = "plain"
    exclude: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("plain", "re"):
            raise PipelineError("mode must be plain or re")

    def field(self, state: State, name: str | None) -> bool:
        found = name is not None and (name in self.fields if self.mode == "plain" else any(re.match(p, name) for p in self.fields))
        return found != self.exclude


# The identifiers in pipeline files.
RULE_CONDITIONS: dict[str, Callable] = {
    "logsource": LogSourceIs,
    "contains_detection_item": HasItem,
    "contains_field": HasField,
    "processing_item_applied": Applied,
    "processing_state": StateIs,
    "is_detection_rule": IsDetectionRule,
    "is_correlation_rule": IsCorrelation,
    "rule_attribute": Attribute,
    "tag": HasTag,
}
ITEM_CONDITIONS: dict[str, Callable] = {
    "match_string": MatchString,
    "match_value": lambda value, **o: MatchValue(value_=value, **o),
    "contains_wildcard": HasWildcard,
    "is_null": IsNull,
    "processing_item_applied": Applied,
    "processing_state": StateIs,
}
FIELD_CONDITIONS: dict[str, Callable] = {
    "include_fields": FieldIn,
    "exclude_fields": lambda **o: FieldIn(exclude=True, **o),
    "processing_item_applied": Applied,
    "processing_state": StateIs,
}


@dataclass
class Group:
    """Conditions of one kind with how they are combined: and, or, or an expression over their names."""

    conditions: dict[str, object] = field(default_factory=dict)
    any: bool = False
    negate: bool = False
    expression: str | None = None

    @classmethod
    def parse(cls, data: object, known: dict[str, Callable], op: str | None, negate: bool, expression: str | None) -> Group:
        if data is None:
            data = []
        named = data if isinstance(data, dict) else {str(i): c for i, c in enumerate(data)}  # type: ignore[arg-type]
        if isinstance(data, dict) and expression is None:
            raise PipelineError("named conditions need an expression")
        if expression is not None and not isinstance(data, dict):
            raise PipelineError("an expression needs named conditions")
        if op not in (None, "and", "or"):
            raise PipelineError(f"conditions are combined by and or or, not {op!r}")
        built = {}
        for name, c in named.items():
            if not isinstance(c, dict):
                built[name] = c  # an object made in code
                continue
            options = dict(c)
            kind = options.pop("type", None)
            if kind not in known and (m := re.fullmatch(r"is_[a-z]+_(correlation_)?rule", str(kind))):
                # pipeline files put the name of their rule format in the middle
                kind = "is_correlation_rule" if m[1] else "is_detection_rule"
            if kind not in known:
                raise PipelineError(f"unknown condition type {kind!r}")
            try:
                built[name] = known[kind](**options)
            except TypeError as e:
                raise PipelineError(f"condition {kind}: {e}") from e
        if expression is not None and (unknown := names_of(parse(expression, selectors=False)) ^ set(built)):
            raise PipelineError(f"names in the expression and conditions differ: {', '.join(sorted(unknown))}")
        return cls(built, op == "or", bool(negate), expression)

    def holds(self, test: Callable[[object], bool]) -> bool:
        if not self.conditions:
            return True
        if self.expression is not None:
            found = self._tree(parse(self.expression, selectors=False), test)
        else:
            found = (any if self.any else all)(test(c) for c in self.conditions.values())
        return found != self.negate

    def _tree(self, node: object, test: Callable[[object], bool]) -> bool:
        match node:
            case Name(n):
                return test(self.conditions[n])
            case And(args):
                return all(self._tree(a, test) for a in args)
            case Or(args):
                return any(self._tree(a, test) for a in args)
            case Not(arg):
                return not self._tree(arg, test)
        raise PipelineError(f"unknown node {node}")
