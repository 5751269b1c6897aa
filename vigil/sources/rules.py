"""Rule files and collections of rules."""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

import yaml

from vigil.errors import ReferenceError_, RuleError, VigilError
from vigil.plans.correlation import Correlation
from vigil.plans.filters import Filter
from vigil.plans.rules import AnyRule, Rule, UniqueKeyLoader


def merged(base: dict, more: dict) -> dict:
    """``base`` with ``more`` in it, maps within maps too."""
    out = copy.deepcopy(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Collection:
    """Rules in the order in which they can be planned, with their filters applied."""

    def __init__(self, rules: Iterable[AnyRule] = (), errors: Iterable[VigilError] = (), resolve: bool = True, collect_errors: bool = False) -> None:
        every = list(rules)
        self.filters: list[Filter] = [r for r in every if isinstance(r, Filter)]
        self.rules: list[AnyRule] = [r for r in every if not isinstance(r, Filter)]
        self.errors: list[VigilError] = [*errors, *(e for r in every for e in r.errors)]
        self.resolved = False
        if resolve:
            try:
                self.resolve()
            except VigilError as e:
                if not collect_errors:
                    raise
                self.errors.append(e)

    @classmethod
    def from_dicts(cls, dicts: Iterable[dict], collect_errors: bool = False, source: object = None, resolve: bool = True) -> Collection:
        """Documents; ``action`` global, reset and repeat carry definitions on to later ones."""
        rules: list[AnyRule] = []
        errors: list[VigilError] = []
        shared: dict = {}
        last: dict = {}
        for i, data in enumerate(dicts, 1):
            if data is None:
                continue
            try:
                if not isinstance(data, dict):
                    raise RuleError(f"document {i} is not a map", source)
                data = dict(data)
                action = data.pop("action", None)
                if action == "global":
                    shared = merged(shared, data)
                    continue
                if action == "reset":
                    shared = {}
                    if not data:
                        continue
                    action = None
                if action not in (None, "repeat"):
                    raise RuleError(f"unknown action {action!r}", source)
                last = merged(last if action == "repeat" else shared, data)
                kind = Correlation if "correlation" in last else Filter if "filter" in last else Rule
                rules.append(kind.from_dict(last, collect_errors, source))
            except VigilError as e:
                if not collect_errors:
                    raise
                errors.append(e)
        return cls(rules, errors, resolve, collect_errors)

    @classmethod
    def from_yaml(cls, text: str | bytes, collect_errors: bool = False, source: object = None, resolve: bool = True) -> Collection:
        try:
            documents = list(yaml.load_all(text, UniqueKeyLoader))
        except (yaml.YAMLError, RuleError) as e:
            error = e if isinstance(e, VigilError) else RuleError(f"not YAML: {e}", source)
            if not collect_errors:
                raise error from e
            return cls([], [error])
        return cls.from_dicts(documents, collect_errors, source, resolve)

    @classmethod
    def load(
        cls,
        paths: Iterable[str | Path],
        collect_errors: bool = False,
        before: Callable[[Path], Path | None] | None = None,
        after: Callable[[Path, Collection], Collection | None] | None = None,
        pattern: str = "**/*.yml",
        resolve: bool = True,
    ) -> Collection:
        """Files, and those below folders that match the pattern. The callbacks may replace or drop a file."""
        found: list[Collection] = []
        for path in resolve_paths(paths, pattern):
            path = before(path) if before else path  # type: ignore[assignment]
            if path is None:
                continue
            one = cls.from_yaml(path.read_bytes(), collect_errors, path, resolve=False)
            one = after(path, one) if after else one  # type: ignore[assignment]
            if one is not None:
                found.append(one)
        return cls.merge(found, resolve, collect_errors)

    @classmethod
    def merge(cls, collections: Iterable[Collection], resolve: bool = True, collect_errors: bool = False) -> Collection:
        every = list(collections)
        rules = [r for c in every for r in (*c.rules, *c.filters)]
        known = {id(e) for r in rules for e in r.errors}
        return cls(rules, [e for c in every for e in c.errors if id(e) not in known], resolve, collect_errors)

    def resolve(self) -> None:
        """Apply filters, check references, and put rules before those that refer to them."""
        if self.resolved:
            return
        rules = []
        for r in self.rules:
            for f in self.filters:
                r = f.apply(r)
            rules.append(r)
        by_key: dict[str, AnyRule] = {}
        for r in rules:
            for key in (r.meta.name, str(r.meta.id) if r.meta.id else None):
                if key:
                    by_key.setdefault(key, r)
        order: list[AnyRule] = []
        state: dict[int, int] = {}

        def visit(rule: AnyRule) -> None:
            if state.get(id(rule)) == 1:
                raise ReferenceError_(f"references of {rule.title!r} form a cycle", rule.source)
            if state.get(id(rule)) == 2:
                return
            state[id(rule)] = 1
            for name in rule.rules if isinstance(rule, Correlation) else ():
                if name not in by_key:
                    raise ReferenceError_(f"{rule.title!r} refers to {name!r}, which is not in the collection", rule.source)
                target = by_key[name]
                target.referenced_by.add(rule.key)
                if not rule.generate:
                    target.output = False
                visit(target)
            state[id(rule)] = 2
            order.append(rule)

        for r in rules:
            visit(r)
        self.rules, self.resolved = order, True

    def __len__(self) -> int:
        return len(self.rules)

    def __iter__(self):
        return iter(self.rules)

    def __getitem__(self, key: int | str | uuid.UUID) -> AnyRule:
        if isinstance(key, int):
            return self.rules[key]
        for r in self.rules:
            if r.is_called(str(key)):
                return r
        raise KeyError(key)

    def output_rules(self) -> list[AnyRule]:
        """Those whose matches are wanted for themselves."""
        return [r for r in self.rules if r.output]

    def unreferenced_rules(self) -> list[AnyRule]:
        return [r for r in self.rules if not r.referenced_by]

    def to_dicts(self) -> list[dict]:
        return [r.to_dict() for r in self.rules]


def resolve_paths(paths: Iterable[str | Path], pattern: str = "**/*.yml") -> list[Path]:
    out: list[Path] = []
    for p in map(Path, paths):
        if not p.exists():
            raise RuleError(f"{p} does not exist")
        out += sorted(p.glob(pattern)) if p.is_dir() else [p]
    return out
