"""Pipelines: items with conditions, post-processing of results, and finalizers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from vigil.errors import PipelineError, SecurityError
from vigil.plans.correlation import Correlation
from vigil.plans.pipeline.conditions import FIELD_CONDITIONS, ITEM_CONDITIONS, RULE_CONDITIONS, Group
from vigil.plans.pipeline.output import FINALIZERS, POSTPROCESSORS
from vigil.plans.pipeline.state import State
from vigil.plans.pipeline.transformations import TRANSFORMATIONS, ExternalPlaceholders, Gate, Nested, Transformation
from vigil.plans.rules import AnyRule, Item, Rule, UniqueKeyLoader


def _identifier(data: object) -> str:
    return "item_" + hashlib.sha256(json.dumps(data, sort_keys=True, default=repr).encode()).hexdigest()[:12]


def _made(kind: object, known: dict, options: dict, what: str) -> object:
    if kind not in known:
        raise PipelineError(f"unknown {what} type {kind!r}")
    try:
        return known[kind](**options)
    except TypeError as e:
        raise PipelineError(f"{what} {kind}: {e}") from e


_PREFIXES = {"rule": RULE_CONDITIONS, "detection_item": ITEM_CONDITIONS, "field_name": FIELD_CONDITIONS}


def _group(data: dict, prefix: str) -> Group:
    return Group.parse(data.pop(f"{prefix}_conditions", None), _PREFIXES[prefix], data.pop(f"{prefix}_cond_op", None), data.pop(f"{prefix}_cond_not", False), data.pop(f"{prefix}_cond_expr", None))


@dataclass
class RuleItem:
    """A transformation and the conditions under which it is applied."""

    transformation: Transformation
    identifier: str = ""
    rule: Group = field(default_factory=Group)
    item: Group = field(default_factory=Group)
    field_name: Group = field(default_factory=Group)

    def __post_init__(self) -> None:
        self.identifier = self.identifier or _identifier(repr(self.transformation))

    @classmethod
    def from_dict(cls, data: dict) -> RuleItem:
        options = dict(data)
        identifier = options.pop("id", None) or _identifier(data)
        kind = options.pop("type", None)
        if kind is None:
            raise PipelineError("a transformation needs a type")
        groups = [_group(options, p) for p in _PREFIXES]
        return cls(_made(kind, TRANSFORMATIONS, options, "transformation"), identifier, *groups)  # type: ignore[arg-type]

    def apply(self, state: State) -> bool:
        if not self.rule.holds(lambda c: c.rule(state)):  # type: ignore[attr-defined]
            return False

        def item(i: Item) -> bool:
            return self.item.holds(lambda c: c.item(state, i))  # type: ignore[attr-defined]

        def name(n: str | None) -> bool:
            return self.field_name.holds(lambda c: c.field(state, n))  # type: ignore[attr-defined]

        self.transformation.apply(state, Gate(self.identifier, item, name))
        state.applied.add(self.identifier)
        state.rule.applied.add(self.identifier)
        return True


@dataclass
class PostItem:
    """A change of the text of a query, for the rules that the conditions let through."""

    transformation: object
    identifier: str = ""
    rule: Group = field(default_factory=Group)

    @classmethod
    def from_dict(cls, data: dict) -> PostItem:
        options = dict(data)
        identifier = options.pop("id", None) or _identifier(data)
        kind = options.pop("type", None)
        group = _group(options, "rule")
        return cls(_made(kind, POSTPROCESSORS, options, "post-processing"), identifier, group)

    def apply(self, state: State, query: str) -> str:
        if not self.rule.holds(lambda c: c.rule(state)):  # type: ignore[attr-defined]
            return query
        state.applied.add(self.identifier)
        return self.transformation.apply(state, query)  # type: ignore[attr-defined]


@dataclass
class Pipeline:
    items: list[RuleItem] = field(default_factory=list)
    postprocessing: list[PostItem] = field(default_factory=list)
    finalizers: list = field(default_factory=list)
    vars: dict = field(default_factory=dict)
    name: str | None = None
    priority: int = 0
    allowed_backends: frozenset[str] = frozenset()

    @classmethod
    def from_dict(cls, data: dict, allow_external: bool = False, base: Path | None = None) -> Pipeline:
        """``allow_external`` trusts the file to fetch values and to name files of variables."""
        if not isinstance(data, dict):
            raise PipelineError("a pipeline must be a map")
        known = {"name", "priority", "transformations", "postprocessing", "finalizers", "vars", "allowed_backends"}
        if unknown := set(data) - known:
            raise PipelineError(f"unknown keys in a pipeline: {', '.join(sorted(map(str, unknown)))}")
        # files can't allow themselves what only their caller may allow
        cleaned = _without(data.get("transformations") or [], "allow_external_sources")
        items = [RuleItem.from_dict(d) for d in cleaned]
        if allow_external:
            for t in _transformations(items):
                if isinstance(t, ExternalPlaceholders):
                    t.allow_external_sources = True
        variables = data.get("vars") or {}
        if isinstance(variables, str):
            if not allow_external:
                raise SecurityError("files of variables are not allowed")
            variables = yaml.safe_load(((base or Path()) / variables).read_text())
        post = [PostItem.from_dict(d) for d in data.get("postprocessing") or []]
        final = []
        for d in data.get("finalizers") or []:
            options = dict(d)
            final.append(_made(options.pop("type", None), FINALIZERS, options, "finalizer"))
        priority = data.get("priority", 0)
        if isinstance(priority, bool) or not isinstance(priority, int):
            raise PipelineError("the priority must be an integer")
        return cls(items, post, final, dict(variables), data.get("name"), priority, frozenset(data.get("allowed_backends") or ()))

    @classmethod
    def from_yaml(cls, text: str, allow_external: bool = False, base: Path | None = None) -> Pipeline:
        try:
            return cls.from_dict(yaml.load(text, UniqueKeyLoader), allow_external, base)
        except yaml.YAMLError as e:
            raise PipelineError(f"not YAML: {e}") from e

    def __add__(self, other: Pipeline | None) -> Pipeline:
        """This pipeline's items, then the other's."""
        if other is None:
            return self
        return Pipeline(self.items + other.items, self.postprocessing + other.postprocessing, self.finalizers + other.finalizers, self.vars | other.vars)

    def __radd__(self, other: Pipeline | int | None) -> Pipeline:
        return self if not other else other + self  # type: ignore[operator]

    def rewrite(self, rule: AnyRule, referenced: Iterable[Rule] = ()) -> tuple[AnyRule, State]:
        """A rewritten copy and the state at its end; the rule itself does not change."""
        copied = rule.copy() if isinstance(rule, Rule | Correlation) else rule
        state = State(copied, dict(self.vars), referenced=list(referenced))
        for item in self.items:
            item.apply(state)
        return copied, state

    def postprocess(self, state: State, query: str) -> str:
        for item in self.postprocessing:
            query = item.apply(state, query)
        return query

    def finalize(self, queries: list) -> object:
        out: object = queries
        for f in self.finalizers:
            out = f.apply(out, self)
        return out


def _without(data: object, key: str) -> object:
    if isinstance(data, dict):
        return {k: _without(v, key) for k, v in data.items() if k != key}
    return [_without(x, key) for x in data] if isinstance(data, list) else data


def _transformations(items: Iterable[RuleItem]) -> Iterable[Transformation]:
    for i in items:
        yield i.transformation
        if isinstance(i.transformation, Nested):
            yield from _transformations(i.transformation._items)
