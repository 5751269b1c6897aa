"""Value modifiers: rewriting of literals before planning."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from vigil.errors import ValueTypeError
from vigil.functions.values import (
    Compare,
    DatePart,
    Exists,
    Expansion,
    FieldRef,
    Flag,
    Network,
    Number,
    Operator,
    PartOfTime,
    Regex,
    RegexFlag,
    Text,
    Value,
    Wild,
)


@dataclass
class Context:
    """What a modifier may look at: the item's field and the modifiers before it."""

    field: str | None
    before: tuple[str, ...]

    @property
    def first(self) -> bool:
        return not self.before


Change = Callable[[Value, Context], Value]
_CHANGES: dict[str, tuple[tuple[type, ...], Change]] = {}
#: Modifiers of the whole list of values rather than of each.
LIST_MODIFIERS = frozenset({"all", "neq"})
DASHES = ("-", "/", "–", "—", "―")


def _modifier(*names: str, accepts: tuple[type, ...]) -> Callable[[Change], Change]:
    def register(fn: Change) -> Change:
        for name in names:
            _CHANGES[name] = (accepts, fn)
        return fn

    return register


def names() -> frozenset[str]:
    return frozenset(_CHANGES) | LIST_MODIFIERS


def _wrapped(value: Value, before: bool, after: bool) -> Value:
    if isinstance(value, FieldRef):
        # open before: the field ends with the other one; open after: it starts with it
        return replace(value, starts=value.starts or after, ends=value.ends or before)
    if isinstance(value, Regex):
        text = value.pattern
        if not text.parts:
            return value
        head, tail = str(text.parts[0]), str(text.parts[-1])
        if before and not head.startswith(("^", ".*")):
            text = ".*" + text
        if after and not tail.endswith(("$", ".*")):
            text = text + ".*"
        return Regex(text, value.flags).checked()
    if before and not value.startswith(Wild.ANY):
        value = Wild.ANY + value
    if after and not value.endswith(Wild.ANY):
        value = value + Wild.ANY
    return value


@_modifier("contains", accepts=(Text, Regex, FieldRef))
def _contains(value: Value, _: Context) -> Value:
    return _wrapped(value, True, True)


@_modifier("startswith", accepts=(Text, Regex, FieldRef))
def _startswith(value: Value, _: Context) -> Value:
    return _wrapped(value, False, True)


@_modifier("endswith", accepts=(Text, Regex, FieldRef))
def _endswith(value: Value, _: Context) -> Value:
    return _wrapped(value, True, False)


def _bytes(value: Text, what: str) -> bytes:
    literal = value.literal()
    if literal is None:
        raise ValueTypeError(f"{what} needs text without wildcards or placeholders, not {value}")
    return literal.encode("utf-8", "surrogateescape")


@_modifier("base64", accepts=(Text,))
def _base64(value: Text, _: Context) -> Value:
    return Text.raw(base64.b64encode(_bytes(value, "base64")).decode())


@_modifier("base64offset", accepts=(Text,))
def _base64offset(value: Text, _: Context) -> Value:
    """The parts of the encoding that do not depend on what surrounds the text, for each alignment."""
    data = _bytes(value, "base64offset")
    out = []
    for offset in range(3):
        encoded = base64.b64encode(bytes(offset) + data).decode().rstrip("=")
        first = (0, 2, 3)[offset]
        spill = (offset + len(data)) % 3
        out.append(Text.raw(encoded[first : len(encoded) - (1 if spill else 0)]))
    return Expansion(tuple(out))


def _recoded(encoding: str, mark: str = "") -> Change:
    def change(value: Text, _: Context) -> Value:
        def recode(text: str) -> str:
            if not text.isascii():
                raise ValueTypeError(f"only ASCII text can be encoded as {encoding}: {text!r}")
            return text.encode(encoding).decode("ascii")

        out = value.map_text(recode)
        return mark + out if mark else out

    return change


_modifier("wide", accepts=(Text,))(_recoded("utf-16-le"))
_modifier("utf16be", accepts=(Text,))(_recoded("utf-16-be"))
# The byte order mark FF FE, one character for each byte, as in the encodings above.
_modifier("utf16", accepts=(Text,))(_recoded("utf-16-le", "\xff\xfe"))


@_modifier("windash", accepts=(Text,))
def _windash(value: Text, _: Context) -> Value:
    """Each dash or slash that begins a word becomes any of the dashes."""
    marked: list = []
    for p in value.parts:
        if not isinstance(p, str):
            marked.append(p)
            continue
        end = 0
        for m in re.finditer(r"\B[-/]\b", p):
            marked += [p[end : m.start()], None]
            end = m.end()
        marked.append(p[end:])
    found = [Text((), value.cased)]
    for p in marked:
        found = [t + x for t in found for x in (DASHES if p is None else (p,))]
    return Expansion(tuple(found))


@_modifier("re", accepts=(Text,))
def _re(value: Text, context: Context) -> Value:
    if not context.first:
        raise ValueTypeError("re must be the first modifier")
    # wildcards are ordinary characters of a pattern
    return Regex(Text.raw(value.plain(escape=False)) if value.has_wildcards else value).checked()


def _flagged(flag: RegexFlag) -> Change:
    return lambda value, _: replace(value, flags=value.flags | {flag})


_modifier("i", "ignorecase", accepts=(Regex,))(_flagged(RegexFlag.IGNORE_CASE))
_modifier("m", "multiline", accepts=(Regex,))(_flagged(RegexFlag.MULTI_LINE))
_modifier("s", "dotall", accepts=(Regex,))(_flagged(RegexFlag.DOT_ALL))


@_modifier("cased", accepts=(Text,))
def _cased(value: Text, _: Context) -> Value:
    return replace(value, cased=True)


@_modifier("cidr", accepts=(Text,))
def _cidr(value: Text, context: Context) -> Value:
    if not context.first:
        raise ValueTypeError("cidr must be the first modifier")
    return Network(value.plain(escape=False))


def _compared(operator: Operator) -> Change:
    return lambda value, _: Compare(operator, value)


for _name, _operator in (("lt", Operator.LT), ("lte", Operator.LTE), ("gt", Operator.GT), ("gte", Operator.GTE)):
    _modifier(_name, accepts=(Number, PartOfTime))(_compared(_operator))


@_modifier("fieldref", accepts=(Text,))
def _fieldref(value: Text, _: Context) -> Value:
    return FieldRef(value.plain(escape=False))


@_modifier("exists", accepts=(Flag,))
def _exists(value: Flag, context: Context) -> Value:
    if context.field is None or not context.first:
        raise ValueTypeError("exists needs a field and must be the first modifier")
    return Exists(value.value)


@_modifier("expand", accepts=(Text, Regex))
def _expand(value: Text | Regex, _: Context) -> Value:
    return value.with_placeholders() if isinstance(value, Text) else Regex(value.pattern.with_placeholders(), value.flags)


def _part(part: DatePart) -> Change:
    return lambda value, _: PartOfTime(part, value)


for _name, _date in (("minute", DatePart.MINUTE), ("hour", DatePart.HOUR), ("day", DatePart.DAY), ("week", DatePart.WEEK), ("month", DatePart.MONTH), ("year", DatePart.YEAR)):
    _modifier(_name, accepts=(Number,))(_part(_date))


def apply(name: str, value: Value, context: Context) -> Value:
    """One modifier on one value; alternatives are changed one by one."""
    if name not in _CHANGES:
        raise ValueTypeError(f"unknown modifier {name!r}")
    if isinstance(value, Expansion):
        changed = [apply(name, v, context) for v in value.values]
        return Expansion(tuple(x for v in changed for x in (v.values if isinstance(v, Expansion) else (v,))))
    accepts, change = _CHANGES[name]
    if not isinstance(value, accepts):
        raise ValueTypeError(f"modifier {name!r} does not apply to {type(value).__name__.lower()} values such as {value}")
    return change(value, context)


def apply_all(modifiers: list[str], values: list[Value], field: str | None) -> tuple[list[Value], bool, bool]:
    """Values after all modifiers, whether all of them must hold, and whether the item is negated."""
    every = negated = False
    for i, name in enumerate(modifiers):
        if name == "all":
            every = True
        elif name == "neq":
            negated = not negated
        else:
            context = Context(field, tuple(modifiers[:i]))
            values = [apply(name, v, context) for v in values]
    return values, every, negated
