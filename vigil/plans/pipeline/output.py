"""Post-processing of query texts, and finalizers of all queries."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import yaml

from vigil.errors import PipelineError, TransformationError
from vigil.plans.pipeline.state import State


@dataclass
class Embed:
    prefix: str = ""
    suffix: str = ""

    def apply(self, state: State, query: str) -> str:
        return self.prefix + query + self.suffix


class _Attributes:
    """Dotted access to data only: what templates may read of a rule."""

    def __init__(self, data: dict) -> None:
        self._data = data

    def __getattr__(self, name: str) -> object:
        if name.startswith("_") or name not in self._data:
            raise AttributeError(name)
        value = self._data[name]
        return _Attributes(value) if isinstance(value, dict) else value

    def __getitem__(self, name: str) -> object:
        return getattr(self, name)


@dataclass
class SimpleTemplate:
    """``str.format`` with the query, the rule's attributes and the pipeline's variables and state."""

    template: str

    def apply(self, state: State, query: str) -> str:
        rule = _Attributes({k: getattr(state.rule.meta, k) for k in state.rule.meta.KNOWN} | state.rule.meta.custom)
        try:
            return self.template.format(query=query, rule=rule, pipeline=_Attributes({"vars": state.vars, "state": state.values}))
        except (AttributeError, KeyError, IndexError) as e:
            raise TransformationError(f"template {self.template!r} names {e}", state.rule.source) from e


def _jinja(template: str | None, path: str | None, **values: object) -> str:
    try:
        from jinja2 import FileSystemLoader
        from jinja2.sandbox import SandboxedEnvironment
    except ImportError as e:
        raise PipelineError("templates need jinja2, which is not installed") from e
    if (template is None) == (path is None):
        raise PipelineError("a template needs either text or a path")
    if path is not None:
        folder, _, name = path.rpartition("/")
        return SandboxedEnvironment(loader=FileSystemLoader(folder or ".")).get_template(name).render(**values)
    return SandboxedEnvironment().from_string(template).render(**values)


@dataclass
class Template:
    template: str | None = None
    path: str | None = None
    vars: dict = field(default_factory=dict)

    def apply(self, state: State, query: str) -> str:
        return _jinja(self.template, self.path, query=query, rule=state.rule.meta, pipeline={"vars": state.vars, "state": state.values}, **self.vars)


@dataclass
class EmbedInJson:
    """``%QUERY%`` in the strings of a JSON document."""

    json_template: str

    def __post_init__(self) -> None:
        try:
            self._data = json.loads(self.json_template)
        except ValueError as e:
            raise PipelineError(f"not JSON: {e}") from e

    def apply(self, state: State, query: str) -> str:
        def fill(x: object) -> object:
            if isinstance(x, str):
                return x.replace("%QUERY%", query)
            return {k: fill(v) for k, v in x.items()} if isinstance(x, dict) else [fill(v) for v in x] if isinstance(x, list) else x

        return json.dumps(fill(self._data))


@dataclass
class Replace:
    pattern: str
    replacement: str

    def __post_init__(self) -> None:
        try:
            re.compile(self.pattern)
        except re.error as e:
            raise PipelineError(f"regular expression {self.pattern!r} is invalid: {e}") from e

    def apply(self, state: State, query: str) -> str:
        return re.sub(self.pattern, self.replacement, query)


@dataclass
class NestedPost:
    items: list

    def __post_init__(self) -> None:
        from vigil.plans.pipeline.core import PostItem

        self._items = [i if isinstance(i, PostItem) else PostItem.from_dict(i) for i in self.items]

    def apply(self, state: State, query: str) -> str:
        for i in self._items:
            query = i.apply(state, query)
        return query


@dataclass
class Concatenate:
    separator: str = "\n"
    prefix: str = ""
    suffix: str = ""

    def apply(self, queries: list, pipeline: object) -> object:
        return self.prefix + self.separator.join(map(str, queries)) + self.suffix


@dataclass
class Json:
    indent: int | None = None

    def apply(self, queries: object, pipeline: object) -> object:
        return json.dumps(queries, indent=self.indent)


@dataclass
class Yaml:
    indent: int | None = None

    def apply(self, queries: object, pipeline: object) -> object:
        return yaml.safe_dump(queries, indent=self.indent)


@dataclass
class TemplateAll:
    template: str | None = None
    path: str | None = None
    vars: dict = field(default_factory=dict)

    def apply(self, queries: object, pipeline: object) -> object:
        return _jinja(self.template, self.path, queries=queries, pipeline=pipeline, **self.vars)


@dataclass
class NestedFinal:
    finalizers: list

    def __post_init__(self) -> None:
        made = []
        for d in self.finalizers:
            if isinstance(d, dict):
                options = dict(d)
                kind = options.pop("type", None)
                if kind not in FINALIZERS:
                    raise PipelineError(f"unknown finalizer type {kind!r}")
                d = FINALIZERS[kind](**options)
            made.append(d)
        self._made = made

    def apply(self, queries: object, pipeline: object) -> object:
        for f in self._made:
            queries = f.apply(queries, pipeline)
        return queries


# The identifiers in pipeline files.
POSTPROCESSORS = {"embed": Embed, "simple_template": SimpleTemplate, "template": Template, "json": EmbedInJson, "replace": Replace, "nest": NestedPost}
FINALIZERS = {"concat": Concatenate, "json": Json, "yaml": Yaml, "template": TemplateAll, "nested": NestedFinal}
