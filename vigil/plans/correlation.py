"""Correlation rules: windowed aggregates over the matches of other rules."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field
from enum import Enum

from vigil.errors import RuleError, VigilError
from vigil.plans.condition import Node, names_of, parse
from vigil.plans.rules import AnyRule, Meta


class Kind(Enum):
    EVENT_COUNT = "event_count"
    VALUE_COUNT = "value_count"
    TEMPORAL = "temporal"
    TEMPORAL_ORDERED = "temporal_ordered"
    VALUE_SUM = "value_sum"
    VALUE_AVG = "value_avg"
    VALUE_PERCENTILE = "value_percentile"
    VALUE_MEDIAN = "value_median"
    EXTENDED_TEMPORAL = "extended_temporal"
    EXTENDED_TEMPORAL_ORDERED = "extended_temporal_ordered"

    @property
    def needs_field(self) -> bool:
        return self.value.startswith("value_")

    @property
    def temporal(self) -> bool:
        return "temporal" in self.value


OPERATORS = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "eq": "=", "neq": "<>"}

# Seconds of each unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2629746, "y": 31556952}


def seconds(text: str) -> int:
    m = re.fullmatch(r"(\d+)([smhdwMy])", str(text).strip())
    if not m:
        raise RuleError(f"{text!r} is not a time span")
    return int(m[1]) * UNITS[m[2]]


@dataclass(frozen=True)
class Threshold:
    operator: str
    value: int | float
    fields: tuple[str, ...] = ()
    percentile: float | None = None

    @classmethod
    def parse(cls, data: dict) -> Threshold:
        given = [k for k in data if k in OPERATORS]
        if len(given) != 1:
            raise RuleError("a correlation condition needs exactly one of " + ", ".join(OPERATORS))
        unknown = set(data) - set(OPERATORS) - {"field", "percentile"}
        if unknown:
            raise RuleError(f"unknown keys in a correlation condition: {', '.join(sorted(map(str, unknown)))}")
        value = data[given[0]]
        if isinstance(value, bool) or not isinstance(value, int | float):
            try:
                value = float(value) if "." in str(value) else int(value)
            except (TypeError, ValueError):
                raise RuleError(f"{value!r} is not a number") from None
        names = data.get("field")
        fields = () if names is None else tuple(names) if isinstance(names, list) else (names,)
        percentile = data.get("percentile")
        if percentile is not None and not 0 <= float(percentile) <= 100:
            raise RuleError(f"percentile {percentile} is not between 0 and 100")
        return cls(given[0], value, fields, None if percentile is None else float(percentile))


@dataclass
class Correlation(AnyRule):
    kind: Kind = Kind.EVENT_COUNT
    rules: list[str] = field(default_factory=list)
    timespan: str = ""
    group_by: list[str] = field(default_factory=list)
    threshold: Threshold | None = None
    expression: Node | None = None  # of extended temporal rules
    expression_text: str | None = None
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    generate: bool = False

    @property
    def seconds(self) -> int:
        return seconds(self.timespan)

    @classmethod
    def from_dict(cls, data: dict, collect_errors: bool = False, source: object = None) -> Correlation:
        errors: list[VigilError] = []
        meta = Meta.parse(data, ("correlation",), errors)
        out = cls(meta, errors, source)
        try:
            out._parse(data.get("correlation"))
        except VigilError as e:
            errors.append(e)
        for e in errors:
            e.source = e.source or source or meta.title
        if errors and not collect_errors:
            raise errors[0]
        return out

    def _parse(self, data: object) -> None:
        if not isinstance(data, dict):
            raise RuleError("a correlation must be a map")
        try:
            self.kind = Kind(data.get("type"))
        except ValueError:
            raise RuleError(f"{data.get('type')!r} is not a correlation type") from None
        condition = data.get("condition")
        rules = data.get("rules")
        if isinstance(condition, str):
            if not self.kind.temporal:
                raise RuleError(f"a {self.kind.value} correlation needs a map as condition")
            self.expression_text, self.expression = condition, parse(condition, selectors=False)
            self.kind = Kind.EXTENDED_TEMPORAL_ORDERED if "ordered" in self.kind.value else Kind.EXTENDED_TEMPORAL
            if rules is None:
                # in the order in which the condition names them
                rules = sorted(names_of(self.expression), key=condition.index)
        if isinstance(rules, str):
            rules = [rules]
        if not isinstance(rules, list) or not rules:
            raise RuleError("a correlation needs rules")
        self.rules = [str(r) for r in rules]
        if self.expression is not None and (unknown := names_of(self.expression) - set(self.rules)):
            raise RuleError(f"the condition names {', '.join(sorted(unknown))}, which the correlation does not refer to")
        groups = data.get("group-by") or []
        self.group_by = [groups] if isinstance(groups, str) else [str(g) for g in groups]
        if data.get("timespan") is None:
            raise RuleError("a correlation needs a time span")
        self.timespan = str(data["timespan"])
        seconds(self.timespan)
        if self.expression is None:
            if isinstance(condition, dict):
                self.threshold = Threshold.parse(condition)
            elif condition is None and self.kind.temporal:
                self.threshold = Threshold("gte", len(self.rules))
            else:
                raise RuleError(f"a {self.kind.value} correlation needs a condition")
            if self.kind.needs_field and not self.threshold.fields:
                raise RuleError(f"a {self.kind.value} correlation needs a field in its condition")
            if self.kind is Kind.VALUE_PERCENTILE and self.threshold.percentile is None:
                raise RuleError("a value_percentile correlation needs a percentile in its condition")
        for alias, mapping in (data.get("aliases") or {}).items():
            if not isinstance(mapping, dict):
                raise RuleError(f"alias {alias} must map rules to fields")
            self.aliases[str(alias)] = {str(k): str(v) for k, v in mapping.items()}
        if not isinstance(data.get("generate", False), bool):
            raise RuleError("generate must be true or false")
        self.generate = data.get("generate", False)

    def copy(self) -> Correlation:
        return copy.deepcopy(self)

    def to_dict(self) -> dict:
        inner: dict = {"type": self.kind.value.removeprefix("extended_"), "rules": list(self.rules), "timespan": self.timespan}
        if self.group_by:
            inner["group-by"] = list(self.group_by)
        if self.aliases:
            inner["aliases"] = copy.deepcopy(self.aliases)
        if self.expression_text is not None:
            inner["condition"] = self.expression_text
        elif self.threshold:
            inner["condition"] = {self.threshold.operator: self.threshold.value}
            if self.threshold.fields:
                inner["condition"]["field"] = list(self.threshold.fields) if len(self.threshold.fields) > 1 else self.threshold.fields[0]
            if self.threshold.percentile is not None:
                inner["condition"]["percentile"] = self.threshold.percentile
        if self.generate:
            inner["generate"] = True
        return self.meta.to_dict() | {"correlation": inner}
