"""Detection rules: metadata, log source, detections, and the predicate trees they give."""

from __future__ import annotations

import copy
import datetime
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

import yaml

from vigil.errors import ConditionError, RuleError, VigilError
from vigil.functions import modifiers as mods
from vigil.functions.values import Expansion, FieldRef, Null, Text, Value, from_yaml, to_yaml
from vigil.plans.condition import And, Node, Not, Or, combined, parse, resolved


class Ordered(Enum):
    """Enumeration values that compare by their place."""

    def __lt__(self, other: Ordered) -> bool:
        members = list(type(self))
        return members.index(self) < members.index(other)

    def __le__(self, other: Ordered) -> bool:
        return self is other or self < other

    def __gt__(self, other: Ordered) -> bool:
        return other < self

    def __ge__(self, other: Ordered) -> bool:
        return other <= self


class Status(Ordered):
    UNSUPPORTED = "unsupported"
    DEPRECATED = "deprecated"
    EXPERIMENTAL = "experimental"
    TEST = "test"
    STABLE = "stable"


class Level(Ordered):
    INFORMATIONAL = "informational"
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"
    CRITICAL = "critical"


class Relation(Enum):
    CORRELATION = "correlation"
    DERIVED = "derived"
    OBSOLETE = "obsolete"
    MERGED = "merged"
    RENAMED = "renamed"
    SIMILAR = "similar"


@dataclass(frozen=True)
class Tag:
    namespace: str
    name: str

    @classmethod
    def parse(cls, text: str) -> Tag:
        namespace, dot, name = str(text).partition(".")
        if not dot or not namespace or not name:
            raise RuleError(f"tag {text!r} is not namespace.name")
        return cls(namespace, name)

    def __str__(self) -> str:
        return f"{self.namespace}.{self.name}"


@dataclass(frozen=True)
class LogSource:
    """Which events a rule is about. An attribute that is not given is open."""

    category: str | None = None
    product: str | None = None
    service: str | None = None
    definition: str | None = field(default=None, compare=False)
    extra: tuple = field(default=(), compare=False)

    @classmethod
    def from_dict(cls, data: object) -> LogSource:
        if not isinstance(data, dict):
            raise RuleError("a log source must be a map")
        known = {k: data[k] for k in ("category", "product", "service", "definition") if data.get(k) is not None}
        bad = [k for k, v in known.items() if not isinstance(v, str)]
        if bad:
            raise RuleError(f"log source {bad[0]} must be a string")
        if not any(k in known for k in ("category", "product", "service")):
            raise RuleError("a log source needs a category, product or service")
        return cls(**known, extra=tuple((k, v) for k, v in data.items() if k not in ("category", "product", "service", "definition")))

    @property
    def key(self) -> tuple[str | None, str | None, str | None]:
        return self.category, self.product, self.service

    def __contains__(self, other: LogSource) -> bool:
        """Whether each attribute given here is the same there."""
        return all(a is None or a == b for a, b in zip(self.key, other.key, strict=True))

    def __str__(self) -> str:
        return "/".join(x or "*" for x in self.key)

    def to_dict(self) -> dict:
        out = {k: v for k, v in zip(("category", "product", "service"), self.key, strict=True) if v is not None}
        return out | ({"definition": self.definition} if self.definition else {}) | dict(self.extra)


@dataclass(frozen=True)
class Leaf:
    """A field, or with none the whole event, against one value."""

    field: str | None
    value: Value


@dataclass
class Item:
    """``field|modifiers: values``. Values are alternatives unless ``every``."""

    field: str | None
    modifiers: list[str]
    values: list[Value]
    every: bool = False
    negated: bool = False
    original: object = None
    applied: set[str] = field(default_factory=set)

    @classmethod
    def parse(cls, key: str | None, data: object) -> Item:
        name, *modifiers = (key or "").split("|")
        modifiers = [m.strip() for m in modifiers if m.strip()]
        unknown = [m for m in modifiers if m not in mods.names()]
        if unknown:
            raise RuleError(f"unknown modifier {unknown[0]!r} in {key!r}")
        plain = list(data) if isinstance(data, list | tuple) else [data]
        raw = "re" in modifiers[:1]
        values: list[Value] = [Text.raw(v) if raw and isinstance(v, str) else Text.raw(str(v)) if raw and isinstance(v, int | float) else from_yaml(v) for v in plain]
        values, every, negated = mods.apply_all(modifiers, values, name or None)
        return cls(name or None, modifiers, values, every, negated, data)

    def tree(self) -> Node | Leaf | None:
        if not self.values:
            if self.field is None:
                raise RuleError("a keyword needs a value")
            leaf: object = Leaf(self.field, Null())
        else:
            leaf = combined(And if self.every else Or, [self._value_tree(v) for v in self.values])
        return Not(leaf) if self.negated else leaf  # type: ignore[return-value]

    def _value_tree(self, value: Value) -> object:
        if isinstance(value, Expansion):
            return combined(Or, [self._value_tree(v) for v in value.values])
        return Leaf(self.field, value)

    def to_plain(self) -> object:
        """A map of one key, or values alone for keywords."""
        plain: object = self.original
        if plain is None or self.applied:
            values = [to_yaml(v) for v in self.values]
            plain = values[0] if len(values) == 1 else values
        key = "|".join([self.field or "", *self.modifiers])
        return plain if not key else {key: plain}


@dataclass
class Detection:
    """Items that must all hold, or nested detections of which one must."""

    items: list[Item | Detection]
    every: bool

    @classmethod
    def parse(cls, data: object) -> Detection:
        if isinstance(data, dict):
            if not data:
                raise RuleError("a detection is empty")
            return cls([Item.parse(k, v) for k, v in data.items()], True)
        if isinstance(data, list):
            if not data:
                raise RuleError("a detection is empty")
            if all(not isinstance(x, dict | list) for x in data):
                return cls([Item.parse(None, data)], True)
            items = [Detection.parse(x) for x in data]
            return cls(list(items), False)
        if isinstance(data, str | int | float):
            return cls([Item.parse(None, data)], True)
        raise RuleError(f"a detection can't be {type(data).__name__}")

    def tree(self) -> object | None:
        return combined(And if self.every else Or, [i.tree() for i in self.items])

    def each_item(self) -> Iterator[Item]:
        for i in self.items:
            if isinstance(i, Item):
                yield i
            else:
                yield from i.each_item()

    def to_plain(self) -> object:
        parts = [i.to_plain() for i in self.items]
        if len(parts) == 1 and not self.every or len(parts) == 1 and not isinstance(parts[0], dict):
            return parts[0]
        if self.every and all(isinstance(p, dict) for p in parts):
            out: dict = {}
            for p in parts:
                if set(out) & set(p):
                    return parts
                out |= p
            return out
        return parts


@dataclass
class Meta:
    """What all kinds of rules say about themselves."""

    title: str = ""
    id: uuid.UUID | None = None
    name: str | None = None
    taxonomy: str = "default"
    related: list[tuple[uuid.UUID, Relation]] = field(default_factory=list)
    status: Status | None = None
    description: str | None = None
    license: str | None = None
    references: list[str] = field(default_factory=list)
    tags: list[Tag] = field(default_factory=list)
    author: str | None = None
    date: datetime.date | None = None
    modified: datetime.date | None = None
    fields: list[str] = field(default_factory=list)
    falsepositives: list[str] = field(default_factory=list)
    level: Level | None = None
    scope: list[str] = field(default_factory=list)
    custom: dict[str, object] = field(default_factory=dict)

    KNOWN = ("title", "id", "name", "taxonomy", "related", "status", "description", "license", "references", "tags", "author", "date", "modified", "fields", "falsepositives", "level", "scope")

    @classmethod
    def parse(cls, data: dict, structure: tuple[str, ...], errors: list[VigilError]) -> Meta:
        """Problems are added to ``errors``; what can be read is kept."""
        out = cls()

        def text(key: str, default: str | None = None) -> str | None:
            value = data.get(key, default)
            if value is not None and not isinstance(value, str):
                errors.append(RuleError(f"{key} must be a string"))
                return default
            return value

        def texts(key: str) -> list[str]:
            value = data.get(key)
            if value is None:
                return []
            if isinstance(value, str) and key in ("fields", "falsepositives", "scope"):
                value = [value]
            if not isinstance(value, list):
                errors.append(RuleError(f"{key} must be a list"))
                return []
            return [str(v) for v in value]

        def choice(key: str, kind: type[Enum]) -> Enum | None:
            value = data.get(key)
            if value is None:
                return None
            try:
                return kind(str(value).lower())
            except ValueError:
                errors.append(RuleError(f"{value!r} is not a {key}"))
                return None

        out.title = text("title", "") or ""
        if not out.title:
            errors.append(RuleError("a rule needs a title"))
        elif len(out.title) > 256:
            errors.append(RuleError("the title is longer than 256 characters"))
        if data.get("id") is not None:
            try:
                out.id = uuid.UUID(str(data["id"]))
            except ValueError:
                errors.append(RuleError(f"{data['id']!r} is not a UUID"))
        out.name = text("name")
        if out.name == "":
            errors.append(RuleError("the name is empty"))
            out.name = None
        out.taxonomy = text("taxonomy", "default") or "default"
        for r in data.get("related") or []:
            try:
                out.related.append((uuid.UUID(str(r["id"])), Relation(str(r["type"]))))
            except (KeyError, TypeError, ValueError):
                errors.append(RuleError(f"{r!r} is not a relation"))
        out.status, out.level = choice("status", Status), choice("level", Level)  # type: ignore[assignment]
        for key in ("description", "license", "author"):
            setattr(out, key, text(key))
        for key in ("references", "fields", "falsepositives", "scope"):
            setattr(out, key, texts(key))
        for t in texts("tags"):
            try:
                out.tags.append(Tag.parse(t))
            except RuleError as e:
                errors.append(e)
        for key in ("date", "modified"):
            if data.get(key) is not None:
                try:
                    setattr(out, key, _date(data[key]))
                except ValueError:
                    errors.append(RuleError(f"{data[key]!r} is not a {key}"))
        out.custom = {k: v for k, v in data.items() if k not in cls.KNOWN and k not in structure}
        return out

    def to_dict(self) -> dict:
        out: dict = {}
        for key in self.KNOWN:
            value = getattr(self, key)
            if value in (None, [], "") or key == "taxonomy" and value == "default":
                continue
            match key:
                case "id":
                    value = str(value)
                case "related":
                    value = [{"id": str(i), "type": t.value} for i, t in value]
                case "status" | "level":
                    value = value.value
                case "tags":
                    value = [str(t) for t in value]
                case "date" | "modified":
                    value = value.isoformat()
            out[key] = value
        return out | self.custom


def _date(value: object) -> datetime.date:
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, datetime.date):
        return value
    parts = re.fullmatch(r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", str(value).strip())
    if not parts:
        raise ValueError(value)
    return datetime.date(*map(int, parts.groups()))


@dataclass
class AnyRule:
    """Base of detection and correlation rules."""

    meta: Meta
    errors: list[VigilError] = field(default_factory=list)
    source: object = None
    applied: set[str] = field(default_factory=set)
    output: bool = True  # whether its own matches are wanted
    referenced_by: set[str] = field(default_factory=set)

    @property
    def title(self) -> str:
        return self.meta.title

    @property
    def key(self) -> str:
        """What its matches are marked with: name, id or title."""
        return self.meta.name or (str(self.meta.id) if self.meta.id else self.meta.title)

    def is_called(self, reference: str) -> bool:
        return reference in (self.meta.name, str(self.meta.id) if self.meta.id else None)


@dataclass
class Rule(AnyRule):
    """A filter query: named detections of a log source, and conditions that each give a query."""

    logsource: LogSource = field(default_factory=LogSource)
    detections: dict[str, Detection] = field(default_factory=dict)
    conditions: list[str] = field(default_factory=list)


    @classmethod
    def from_dict(cls, data: dict, collect_errors: bool = False, source: object = None) -> Rule:
        errors: list[VigilError] = []
        meta = Meta.parse(data, ("logsource", "detection"), errors)
        logsource, detections, conditions = LogSource(), {}, []
        try:
            if "logsource" not in data:
                raise RuleError("a rule needs a log source")
            logsource = LogSource.from_dict(data["logsource"])
        except VigilError as e:
            errors.append(e)
        try:
            detections, conditions = parse_detections(data.get("detection"))
        except VigilError as e:
            errors.append(e)
        for e in errors:
            e.source = e.source or source or meta.title
        if errors and not collect_errors:
            raise errors[0]
        return cls(meta, errors, source, logsource=logsource, detections=detections, conditions=conditions)

    @classmethod
    def from_yaml(cls, text: str, collect_errors: bool = False) -> Rule:
        data = yaml.load(text, UniqueKeyLoader)
        if not isinstance(data, dict):
            raise RuleError("a rule must be a map")
        return cls.from_dict(data, collect_errors)

    def trees(self) -> list[object | None]:
        """A predicate tree for each condition; None where nothing is left."""
        names = list(self.detections)
        out = []
        for c in self.conditions:
            tree = resolved(parse(c), names, lambda n: self.detections[n].tree())
            out.append(tree)
        return out

    def each_item(self) -> Iterator[Item]:
        for d in self.detections.values():
            yield from d.each_item()

    def copy(self) -> Rule:
        return copy.deepcopy(self)

    def to_dict(self) -> dict:
        detection = {n: d.to_plain() for n, d in self.detections.items()}
        detection["condition"] = self.conditions[0] if len(self.conditions) == 1 else list(self.conditions)
        return self.meta.to_dict() | {"logsource": self.logsource.to_dict(), "detection": detection}


def parse_detections(data: object) -> tuple[dict[str, Detection], list[str]]:
    if not isinstance(data, dict):
        raise RuleError("a detection section must be a map")
    named = {k: v for k, v in data.items() if k not in ("condition", "timeframe")}
    if not named:
        raise RuleError("a rule needs a named detection")
    conditions = data.get("condition")
    if conditions is None:
        raise ConditionError("a rule needs a condition")
    conditions = conditions if isinstance(conditions, list) else [conditions]
    if not conditions or not all(isinstance(c, str) for c in conditions):
        raise ConditionError("conditions must be strings")
    detections = {}
    for name, d in named.items():
        try:
            detections[str(name)] = Detection.parse(d)
        except VigilError as e:
            raise type(e)(f"{e.args[0]} (detection {name})") from e
    return detections, conditions


class UniqueKeyLoader(yaml.SafeLoader):
    """Refuses maps with a key twice."""

    def construct_mapping(self, node: yaml.MappingNode, deep: bool = False) -> dict:
        seen = set()
        for key_node, _ in node.value:
            key = self.construct_object(key_node, deep=True)
            if isinstance(key, str | int | float | bool) and key in seen:
                raise RuleError(f"key {key!r} occurs twice")
            if isinstance(key, str | int | float | bool):
                seen.add(key)
        return super().construct_mapping(node, deep)


def tree_fields(tree: object) -> set[str]:
    """Fields that a predicate tree reads."""
    match tree:
        case And(args) | Or(args):
            return set().union(*map(tree_fields, args))
        case Not(arg):
            return tree_fields(arg)
        case Leaf(name, value):
            more = {value.field} if isinstance(value, FieldRef) else set()
            return ({name} if name is not None else set()) | more
    return set()
