"""Literal values of detection items.

Strings are sequences of plain text, wildcards and placeholders; everything is
immutable, so rewriting a rule never changes the one it came from.
"""

from __future__ import annotations

import ipaddress
import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from enum import Enum

from vigil.errors import ValueTypeError


class Wild(Enum):
    """A wildcard: any run of characters, or one character."""

    ANY = "*"
    ONE = "?"


@dataclass(frozen=True)
class Placeholder:
    """A named gap that a pipeline must fill."""

    name: str


Part = str | Wild | Placeholder


def _merged(parts: Iterable[Part]) -> tuple[Part, ...]:
    out: list[Part] = []
    for p in parts:
        if isinstance(p, str):
            if not p:
                continue
            if out and isinstance(out[-1], str):
                out[-1] += p
                continue
        out.append(p)
    return tuple(out)


@dataclass(frozen=True)
class Text:
    """A string value. Compared without regard to case unless ``cased``."""

    parts: tuple[Part, ...] = ()
    cased: bool = False

    @classmethod
    def parse(cls, text: str) -> Text:
        """``*`` and ``?`` are wildcards; a backslash escapes those two and itself, else it is literal."""
        out: list[Part] = []
        at = 0
        while at < len(text):
            c = text[at]
            if c == "\\" and at + 1 < len(text) and text[at + 1] in "*?\\":
                out.append(text[at + 1])
                at += 2
                continue
            out.append(Wild(c) if c in "*?" else c)
            at += 1
        return cls(_merged(out))

    @classmethod
    def raw(cls, text: str) -> Text:
        """All characters literal."""
        return cls((text,) if text else ())

    def _units(self) -> list[Part]:
        """Characters, wildcards and placeholders one by one."""
        return [u for p in self.parts for u in (p if isinstance(p, str) else (p,))]

    def __len__(self) -> int:
        return len(self._units())

    def __getitem__(self, index: int | slice) -> Text:
        units = self._units()
        return replace(self, parts=_merged(units[index] if isinstance(index, slice) else [units[index]]))

    def __add__(self, other: Text | str | Wild | Placeholder) -> Text:
        more = other.parts if isinstance(other, Text) else (other,)
        return replace(self, parts=_merged((*self.parts, *more)))

    def __radd__(self, other: str | Wild | Placeholder) -> Text:
        return replace(self, parts=_merged((other, *self.parts)))

    def startswith(self, part: str | Wild) -> bool:
        if not self.parts:
            return part == ""
        first = self.parts[0]
        return first.startswith(part) if isinstance(first, str) and isinstance(part, str) else first == part

    def endswith(self, part: str | Wild) -> bool:
        if not self.parts:
            return part == ""
        last = self.parts[-1]
        return last.endswith(part) if isinstance(last, str) and isinstance(part, str) else last == part

    @property
    def has_wildcards(self) -> bool:
        return any(isinstance(p, Wild) for p in self.parts)

    @property
    def placeholders(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.parts if isinstance(p, Placeholder))

    def has_placeholder(self, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> bool:
        return any((include is None or n in include) and (exclude is None or n not in exclude) for n in self.placeholders)

    def plain(self, escape: bool = True) -> str:
        """As text that parses to the same value; without ``escape`` as the bare characters."""
        out = []
        for p in self.parts:
            if isinstance(p, str):
                out.append(re.sub(r"([*?])", r"\\\1", p) if escape else p)
            else:
                out.append(p.value if isinstance(p, Wild) else f"%{p.name}%")
        return "".join(out)

    def __str__(self) -> str:
        return self.plain()

    def literal(self) -> str | None:
        """The text if it has neither wildcards nor placeholders."""
        return "".join(self.parts) if all(isinstance(p, str) for p in self.parts) else None  # type: ignore[arg-type]

    def map_text(self, fn: Callable[[str], str]) -> Text:
        return replace(self, parts=_merged(fn(p) if isinstance(p, str) else p for p in self.parts))

    def with_placeholders(self) -> Text:
        """``%name%`` becomes a placeholder unless a backslash precedes it."""
        out: list[Part] = []
        for p in self.parts:
            if not isinstance(p, str):
                out.append(p)
                continue
            end = 0
            for m in re.finditer(r"(?<!\\)%([^\s%]+)%", p):
                out += [p[end : m.start()], Placeholder(m[1])]
                end = m.end()
            out.append(p[end:])
        return replace(self, parts=_merged(out))

    def fill(self, values: Callable[[Placeholder], Iterable[Part | Text]]) -> Iterator[Text]:
        """All combinations of replacements of the placeholders."""
        choices: list[list[tuple[Part, ...]]] = []
        for p in self.parts:
            if isinstance(p, Placeholder):
                choices.append([v.parts if isinstance(v, Text) else (v,) for v in values(p)])
            else:
                choices.append([(p,)])
        for combination in itertools.product(*choices):
            yield replace(self, parts=_merged(itertools.chain.from_iterable(combination)))

    def regex(self) -> str:
        """An unanchored pattern of the same strings."""
        self.check_filled()
        return "".join(re.escape(p) if isinstance(p, str) else ".*" if p is Wild.ANY else "." for p in self.parts)

    def like(self, escape: str = "~") -> str:
        """A LIKE pattern."""
        self.check_filled()
        quote = re.compile(f"([%_{re.escape(escape)}])")
        return "".join(quote.sub(lambda m: escape + m[1], p) if isinstance(p, str) else "%" if p is Wild.ANY else "_" for p in self.parts)

    def check_filled(self) -> None:
        if self.placeholders:
            raise ValueTypeError(f"placeholders are not replaced: {', '.join(self.placeholders)}")

    def lower(self) -> Text:
        return self.map_text(str.lower)

    def upper(self) -> Text:
        return self.map_text(str.upper)

    def snake_case(self) -> Text:
        def snake(text: str) -> str:
            spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
            return re.sub(r"[\s\-]+", "_", spaced).lower()

        return self.map_text(snake)


@dataclass(frozen=True)
class Number:
    value: int | float

    def __post_init__(self) -> None:
        if isinstance(self.value, float):
            if not math.isfinite(self.value):
                raise ValueTypeError(f"not a finite number: {self.value}")
            if self.value.is_integer():
                object.__setattr__(self, "value", int(self.value))

    def __str__(self) -> str:
        return str(self.value)


class DatePart(Enum):
    MINUTE = "minute"
    HOUR = "hour"
    DAY = "dayofmonth"
    WEEK = "weekofyear"
    MONTH = "month"
    YEAR = "year"


@dataclass(frozen=True)
class PartOfTime:
    """A number that a part of a timestamp is compared with."""

    part: DatePart
    number: Number


@dataclass(frozen=True)
class Flag:
    value: bool


@dataclass(frozen=True)
class Null:
    pass


@dataclass(frozen=True)
class Exists:
    wanted: bool


class RegexFlag(Enum):
    IGNORE_CASE = "i"
    MULTI_LINE = "m"
    DOT_ALL = "s"


@dataclass(frozen=True)
class Regex:
    """A pattern that may have placeholders; it is checked once those are filled."""

    pattern: Text
    flags: frozenset[RegexFlag] = frozenset()

    @classmethod
    def of(cls, text: str, *flags: RegexFlag) -> Regex:
        return cls(Text.raw(text), frozenset(flags)).checked()

    @property
    def text(self) -> str:
        self.pattern.check_filled()
        return "".join(self.pattern.parts)  # type: ignore[arg-type]

    def checked(self) -> Regex:
        if not self.pattern.placeholders:
            try:
                re.compile(self.text)
            except re.error as e:
                raise ValueTypeError(f"regular expression {self.text!r} is invalid: {e}") from e
        return self

    def __str__(self) -> str:
        return self.pattern.plain(escape=False)


@dataclass(frozen=True)
class Network:
    cidr: str

    def __post_init__(self) -> None:
        try:
            self.network  # noqa: B018
        except ValueError as e:
            raise ValueTypeError(f"not a network: {self.cidr}: {e}") from e

    @property
    def network(self) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
        return ipaddress.ip_network(self.cidr)

    def wildcards(self) -> list[str]:
        """Patterns of addresses as written that together cover the network."""
        net = self.network
        if isinstance(net, ipaddress.IPv4Network):
            step = -(-net.prefixlen // 8) * 8
            subs = net.subnets(new_prefix=step) if step > net.prefixlen else [net]
            return [str(s.network_address) if step == 32 else ".".join([*str(s.network_address).split(".")[: step // 8], "*"]) for s in subs]
        step = -(-net.prefixlen // 4) * 4
        subs6 = net.subnets(new_prefix=step) if step > net.prefixlen else [net]
        out = []
        for s in subs6:
            digits = s.network_address.exploded.replace(":", "")[: step // 4]
            groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
            out.append(":".join(groups) + ("" if step == 128 else "*" if len(groups) and len(groups[-1]) < 4 else ":*" if groups else "*"))
        return out


class Operator(Enum):
    LT = "<"
    LTE = "<="
    GT = ">"
    GTE = ">="
    NEQ = "!="


@dataclass(frozen=True)
class Compare:
    operator: Operator
    number: Number | PartOfTime


@dataclass(frozen=True)
class FieldRef:
    """The value of another field, whole, or as a beginning, an end or a part."""

    field: str
    starts: bool = False
    ends: bool = False


@dataclass(frozen=True)
class RawQuery:
    """Spark SQL with ``{field}`` and ``{id}`` gaps."""

    sql: str
    id: str = ""


@dataclass(frozen=True)
class Expansion:
    """Alternatives that stay OR-linked whatever links the values around them."""

    values: tuple[Value, ...]


Value = Text | Number | PartOfTime | Flag | Null | Exists | Regex | Network | Compare | FieldRef | RawQuery | Expansion


def from_yaml(value: object) -> Value:
    """The typed value of a YAML scalar."""
    if value is None:
        return Null()
    if isinstance(value, bool):
        return Flag(value)
    if isinstance(value, int | float):
        return Number(value)
    if isinstance(value, str):
        return Text.parse(value)
    if hasattr(value, "isoformat"):
        return Text.raw(value.isoformat())
    raise ValueTypeError(f"values of type {type(value).__name__} are not supported")


def to_yaml(value: Value) -> object:
    """The scalar that reads as the value, where one exists."""
    match value:
        case Null():
            return None
        case Flag(v) | Exists(v):
            return v
        case Number(v):
            return v
        case Text():
            return value.plain()
        case Regex():
            return str(value)
        case Network(c):
            return c
        case Compare(_, PartOfTime(_, Number(v))) | Compare(_, Number(v)) | PartOfTime(_, Number(v)):
            return v
        case FieldRef(f):
            return f
        case RawQuery(sql):
            return sql
    raise ValueTypeError(f"{value} has no plain form")
