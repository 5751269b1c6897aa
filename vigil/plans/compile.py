"""Predicate trees to Spark SQL expressions.

Expressions are built as text and parsed once, since composing Column objects costs
a call to the JVM for each node. Missing and null fields make a leaf false: positive
leaves stay bare, so that the scan can use them, and what stands below a NOT is
wrapped to be false where it is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.errors import PlanError
from vigil.functions.values import (
    Compare,
    Exists,
    FieldRef,
    Flag,
    Network,
    Null,
    Number,
    Operator,
    PartOfTime,
    RawQuery,
    Regex,
    Text,
    Value,
    Wild,
)
from vigil.plans.condition import And, Not, Or
from vigil.plans.rules import Leaf

NETWORK_UDF = "vigil_in_network"


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(value: int | float) -> str:
    if isinstance(value, int):
        return str(value) if -(2**31) <= value < 2**31 else f"{value}L" if -(2**63) <= value < 2**63 else f"CAST({quote(str(value))} AS DOUBLE)"
    return f"{value!r}D"


@dataclass(frozen=True)
class Ref:
    """A field of the table as SQL, with its type."""

    sql: str
    kind: T.DataType

    @property
    def textual(self) -> bool:
        return isinstance(self.kind, T.StringType)

    @property
    def numeric(self) -> bool:
        return isinstance(self.kind, T.NumericType)


@dataclass
class Fields:
    """How field names are found in a table.

    In this order: ``derived`` SQL expressions, exact columns, columns but for case,
    paths through structs, and paths into ``json_columns``. A name that is not found
    has no values; ``strict`` raises instead. Keywords look in ``keyword_columns``.
    """

    schema: T.StructType
    json_columns: tuple[str, ...] = ()
    keyword_columns: tuple[str, ...] = ()
    derived: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # name: (SQL, type)
    strict: bool = False

    def find(self, name: str) -> Ref | None:
        if name in self.derived:
            sql, kind = self.derived[name]
            return Ref(f"({sql})", T._parse_datatype_string(kind) if not isinstance(kind, T.DataType) else kind)
        found = self._column(name) or self._path(name) or self._json(name)
        if found is None and self.strict:
            raise PlanError(f"field {name!r} is not in the table")
        return found

    def _column(self, name: str) -> Ref | None:
        for same in (lambda a: a == name, lambda a: a.lower() == name.lower()):
            for f in self.schema.fields:
                if same(f.name):
                    return Ref(quote_name(f.name), f.dataType)
        return None

    def _path(self, name: str) -> Ref | None:
        first, *rest = name.split(".")
        ref = self._column(first)
        for step in rest:
            if ref is None or not isinstance(ref.kind, T.StructType):
                return None
            match = next((f for f in ref.kind.fields if f.name == step), None) or next((f for f in ref.kind.fields if f.name.lower() == step.lower()), None)
            ref = Ref(f"{ref.sql}.{quote_name(match.name)}", match.dataType) if match else None
        return ref

    def _json(self, name: str) -> Ref | None:
        for column in self.json_columns:
            if name.startswith(column + "."):
                path = "$" + "".join(f"['{p}']" for p in name[len(column) + 1 :].replace("'", "").split("."))
                return Ref(f"get_json_object({quote_name(column)}, {quote(path)})", T.StringType())
        return None


_JAVA = ((re.compile(r"\(\?P<([A-Za-z_]\w*)>"), lambda m: f"(?<{m[1].replace('_', '')}>"), (re.compile(r"\(\?P=([A-Za-z_]\w*)\)"), lambda m: f"\\k<{m[1].replace('_', '')}>"))


def java_regex(regex: Regex) -> str:
    """The pattern in Java's dialect, with its flags."""
    text = regex.text
    if re.search(r"(?<!\\)(?:\\\\)*\(\?\(", text):
        raise PlanError(f"conditional groups are not supported: {text!r}")
    for pattern, change in _JAVA:
        text = pattern.sub(change, text)
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", text)
    flags = "".join(sorted(f.value for f in regex.flags))
    return (f"(?{flags})" if flags else "") + text


def _lowered(text: str) -> str:
    return quote(text.lower()) if text.isascii() else f"lower({quote(text)})"


def text_predicate(column: str, value: Text) -> str:
    """A string column against a string value."""
    value.check_filled()
    wrap = (lambda s: s) if value.cased else (lambda s: f"lower({s})")
    literal = quote if value.cased else _lowered
    parts = value.parts
    if not value.has_wildcards:
        return f"{wrap(column)} = {literal(value.literal() or '')}"
    if set(parts) == {Wild.ANY}:
        return f"{column} IS NOT NULL"
    inner = value[1:] if parts[0] is Wild.ANY else value
    inner = inner[:-1] if inner.parts[-1] is Wild.ANY else inner
    plain = inner.literal()
    if plain is not None:
        fn = {(True, True): "contains", (True, False): "endswith", (False, True): "startswith"}[parts[0] is Wild.ANY, parts[-1] is Wild.ANY]
        return f"{fn}({wrap(column)}, {literal(plain)})"
    return f"{wrap(column)} LIKE {literal(value.like())} ESCAPE '~'"


def _as_text(ref: Ref) -> str:
    return ref.sql if ref.textual else f"CAST({ref.sql} AS STRING)"


def _as_number(ref: Ref) -> str:
    if ref.numeric:
        return ref.sql
    if ref.textual:
        return f"try_cast({ref.sql} AS DOUBLE)"
    if isinstance(ref.kind, T.BooleanType):
        return f"CAST({ref.sql} AS INT)"
    raise PlanError(f"{ref.sql} of type {ref.kind.simpleString()} can't be compared with a number")


def _as_time(ref: Ref) -> str:
    return f"try_to_timestamp({ref.sql})" if ref.textual else ref.sql


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _network(column: str, value: Network) -> str:
    """Whole octets of the prefix are a prefix of the text, which comes first; what is left of it bounds one more octet."""
    net = value.network
    if net.version == 6:
        return f"{NETWORK_UDF}({column}, {quote(str(net))})"
    whole, rest = divmod(net.prefixlen, 8)
    octets = str(net.network_address).split(".")
    if whole == 4:
        return f"{column} = {quote(str(net.network_address))}"
    tests = [f"startswith({column}, {quote('.'.join(octets[:whole]) + '.')})"] if whole else []
    tests.append(f"{column} RLIKE '^{_OCTET}(?:\\\\.{_OCTET}){{3}}$'")
    if rest:
        low = int(octets[whole])
        tests.append(f"try_cast(split_part({column}, '.', {whole + 1}) AS INT) BETWEEN {low} AND {low + 2 ** (8 - rest) - 1}")
    return "(" + " AND ".join(tests) + ")"


def _leaf(ref: Ref, value: Value, fields: Fields) -> str:
    """A field that exists against a value."""
    if isinstance(ref.kind, T.ArrayType) and not isinstance(value, Null | Exists):
        return f"exists({ref.sql}, x -> {_leaf(Ref('x', ref.kind.elementType), value, fields)})"
    match value:
        case Null():
            return f"{ref.sql} IS NULL"
        case Exists(wanted):
            return f"{ref.sql} IS {'NOT ' if wanted else ''}NULL"
        case Text():
            plain = value.literal()
            if ref.numeric and plain is not None and re.fullmatch(r"[+-]?\d+(?:\.\d+)?", plain):
                return f"{ref.sql} = {number(float(plain) if '.' in plain else int(plain))}"
            return text_predicate(_as_text(ref), value)
        case Number(n):
            return f"{_as_number(ref)} = {number(n)}"
        case PartOfTime(part, Number(n)):
            return f"{part.value}({_as_time(ref)}) = {number(n)}"
        case Flag(flag):
            if isinstance(ref.kind, T.BooleanType):
                return f"{ref.sql} = {str(flag).lower()}"
            return f"{ref.sql} = {int(flag)}" if ref.numeric else f"lower({_as_text(ref)}) = '{str(flag).lower()}'"
        case Regex():
            return f"{_as_text(ref)} RLIKE {quote(java_regex(value))}"
        case Network():
            return _network(_as_text(ref), value)
        case Compare(operator, PartOfTime(part, Number(n))):
            return f"{part.value}({_as_time(ref)}) {operator.value} {number(n)}"
        case Compare(operator, Number(n)):
            sign = "<>" if operator is Operator.NEQ else operator.value
            return f"{_as_number(ref)} {sign} {number(n)}"
        case FieldRef(name, starts, ends):
            other = fields.find(name)
            if other is None:
                return "false"
            if not starts and not ends and ref.numeric and other.numeric:
                return f"{ref.sql} = {other.sql}"
            a, b = f"lower({_as_text(ref)})", f"lower({_as_text(other)})"
            fn = {(True, True): "contains", (True, False): "startswith", (False, True): "endswith"}.get((starts, ends))
            return f"{fn}({a}, {b})" if fn else f"{a} = {b}"
        case RawQuery(sql, key):
            return "(" + sql.replace("{field}", ref.sql).replace("{id}", key) + ")"
    raise PlanError(f"no predicate for {value}")


def _keyword(value: Value, fields: Fields) -> str:
    """A value without a field: somewhere in one of the keyword columns."""
    if isinstance(value, RawQuery):
        return "(" + value.sql.replace("{id}", value.id) + ")"
    if not fields.keyword_columns:
        raise PlanError("the table has no keyword columns")
    found = []
    for name in fields.keyword_columns:
        ref = fields.find(name)
        if ref is None:
            continue
        match value:
            case Text():
                whole = value if value.startswith(Wild.ANY) else Wild.ANY + value
                found.append(text_predicate(_as_text(ref), whole if whole.endswith(Wild.ANY) else whole + Wild.ANY))
            case Number(n):
                found.append(f"contains({_as_text(ref)}, {quote(str(n))})")
            case Regex():
                found.append(f"{_as_text(ref)} RLIKE {quote(java_regex(value))}")
            case _:
                raise PlanError(f"{value} needs a field")
    return "(" + " OR ".join(found) + ")" if found else "false"


class Compiler:
    """Trees to SQL text for one table."""

    def __init__(self, fields: Fields) -> None:
        self.fields = fields

    def sql(self, tree: object | None) -> str | None:
        """The expression, or None where nothing is left to ask."""
        return None if tree is None else self._node(tree)

    def _node(self, tree: object) -> str:
        match tree:
            case Leaf(None, value):
                return _keyword(value, self.fields)
            case Leaf(name, value):
                ref = self.fields.find(name)
                if ref is None:
                    return "true" if isinstance(value, Null) or isinstance(value, Exists) and not value.wanted else "false"
                return _leaf(ref, value, self.fields)
            case Not(arg):
                return f"(NOT coalesce({self._node(arg)}, false))"
            case And(args):
                return "(" + " AND ".join(self._node(a) for a in args) + ")"
            case Or(args):
                found = self._with_lists(args)
                return found[0] if len(found) == 1 else "(" + " OR ".join(found) + ")"
        raise PlanError(f"unknown node {tree}")

    def needed(self, tree: object | None) -> str | None:
        """A predicate that holds wherever the tree does, of comparisons that a scan can test; None if there is none."""
        match tree:
            case Leaf(name, value) if name is not None:
                ref = self.fields.find(name)
                plain = ref is not None and ref.sql.startswith("`") and not isinstance(ref.kind, T.ArrayType)
                if plain and (isinstance(value, Text) and value.cased and ref.textual and not value.has_wildcards and not value.placeholders):
                    return self._node(tree)
                if plain and ref.numeric and isinstance(value, Number | Compare) and not (isinstance(value, Compare) and not isinstance(value.number, Number)):
                    return self._node(tree)
                if plain and ref.numeric and isinstance(value, Text) and value.literal() is not None and re.fullmatch(r"[+-]?\d+(?:\.\d+)?", value.literal() or ""):
                    return self._node(tree)
            case And(args):
                found = [n for a in args if (n := self.needed(a))]
                return "(" + " AND ".join(found) + ")" if found else None
            case Or(args):
                found = [self.needed(a) for a in args]
                if all(found):
                    return "(" + " OR ".join(found) + ")"  # type: ignore[arg-type]
        return None

    def _with_lists(self, args: Iterable[object]) -> list[str]:
        """Alternatives; equalities of one field become one IN."""
        out: list[str] = []
        groups: dict[tuple, list[Value]] = {}
        for a in args:
            key = None
            if isinstance(a, Leaf) and a.field is not None:
                v = a.value
                if isinstance(v, Text) and not v.has_wildcards and not v.placeholders:
                    key = (a.field, "cased" if v.cased else "text")
                elif isinstance(v, Number):
                    key = (a.field, "number")
            if key is None:
                out.append(self._node(a))
                continue
            if key not in groups:
                groups[key] = []
                out.append(key)  # type: ignore[arg-type]
            groups[key].append(a.value)  # type: ignore[union-attr]
        return [self._listed(*x, groups[x]) if isinstance(x, tuple) else x for x in out]

    def _listed(self, name: str, kind: str, values: list) -> str:
        ref = self.fields.find(name)
        single = ref is None or len(values) == 1 or isinstance(ref.kind, T.ArrayType)
        if not single and kind == "number" and (ref.numeric or ref.textual):
            return f"{_as_number(ref)} IN ({', '.join(number(v.value) for v in values)})"
        if not single and kind != "number" and ref.textual:
            column, literal = (ref.sql, quote) if kind == "cased" else (f"lower({ref.sql})", _lowered)
            return f"{column} IN ({', '.join(literal(v.literal()) for v in values)})"
        found = [self._node(Leaf(name, v)) for v in values]
        return found[0] if len(found) == 1 else "(" + " OR ".join(found) + ")"


def register(spark: SparkSession) -> None:
    """Make the functions known that expressions may name: IPv6 networks have no built-in test."""

    def in_network(ip: pd.Series, cidr: pd.Series) -> pd.Series:
        import ipaddress

        nets = {c: ipaddress.ip_network(c) for c in cidr.unique()}

        def test(address: str | None, c: str) -> bool | None:
            if address is None:
                return None
            try:
                parsed = ipaddress.ip_address(address)
            except ValueError:
                return False
            return parsed.version == nets[c].version and parsed in nets[c]

        return pd.Series([test(a, c) for a, c in zip(ip, cidr, strict=True)], dtype=object)

    spark.udf.register(NETWORK_UDF, F.pandas_udf(in_network, "boolean"))
