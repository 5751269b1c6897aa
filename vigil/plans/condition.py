"""Conditions over names: parsing, selectors, and the boolean trees they become."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from vigil.errors import ConditionError


_OF_FILTER = re.compile(r"_filter\d+_")


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Selector:
    """``1 of``, ``any of`` or ``all of`` the names that match a pattern, or of them all."""

    every: bool
    pattern: str | None  # None: them

    def matching(self, names: list[str]) -> list[str]:
        """Names with a leading underscore are hidden unless the pattern has one too; names that filters brought along always are."""
        shown = [n for n in names if not _OF_FILTER.match(n) and (not n.startswith("_") or (self.pattern or "").startswith("_"))]
        return shown if self.pattern is None else [n for n in shown if fnmatch.fnmatchcase(n, self.pattern.replace("[", "[[]"))]


@dataclass(frozen=True)
class And:
    args: tuple


@dataclass(frozen=True)
class Or:
    args: tuple


@dataclass(frozen=True)
class Not:
    arg: object


Node = Name | Selector | And | Or | Not

_TOKEN = re.compile(r"\s*(?:(?P<quoted>\"[^\"]*\"|'[^']*')|(?P<word>[A-Za-z0-9_*?.\-]+)|(?P<sign>[()|]))")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"unexpected {text[at:].strip()[:20]!r} in condition {text!r}")
        kind = m.lastgroup or ""
        out.append((kind, m[kind][1:-1] if kind == "quoted" else m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, selectors: bool) -> None:
        self.text, self.selectors = text, selectors
        self.tokens, self.at = _tokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        at = self.at + ahead
        return self.tokens[at] if at < len(self.tokens) else ("", "")

    def fail(self) -> ConditionError:
        kind, token = self.peek()
        return ConditionError(f"unexpected {token!r} in condition {self.text!r}" if kind else f"condition {self.text!r} ends early")

    def word(self, *wanted: str) -> bool:
        kind, token = self.peek()
        return kind == "word" and token.lower() in wanted

    def chain(self, word: str, below: Callable[[], Node], node: type) -> Node:
        args = [below()]
        while self.word(word):
            self.at += 1
            args.append(below())
        return args[0] if len(args) == 1 else node(tuple(args))

    def disjunction(self) -> Node:
        return self.chain("or", self.conjunction, Or)

    def conjunction(self) -> Node:
        return self.chain("and", self.negation, And)

    def negation(self) -> Node:
        if self.word("not"):
            self.at += 1
            return Not(self.negation())
        return self.atom()

    def atom(self) -> Node:
        kind, token = self.peek()
        if (kind, token) == ("sign", "("):
            self.at += 1
            inner = self.disjunction()
            if self.peek() != ("sign", ")"):
                raise self.fail()
            self.at += 1
            return inner
        if self.selectors and self.word("1", "any", "all") and self.peek(1)[1].lower() == "of":
            self.at += 2
            kind, pattern = self.peek()
            if kind not in ("word", "quoted"):
                raise self.fail()
            self.at += 1
            return Selector(token.lower() == "all", None if pattern.lower() == "them" else pattern)
        if kind not in ("word", "quoted") or kind == "word" and token.lower() in ("and", "or", "not", "of"):
            raise self.fail()
        self.at += 1
        return Name(token)

    def parse(self) -> Node:
        out = self.disjunction()
        if self.at < len(self.tokens):
            if self.peek()[1] == "|":
                raise ConditionError(f"aggregations behind a pipe are not supported: {self.text!r}; use a correlation rule")
            raise self.fail()
        return out


@lru_cache(maxsize=1024)
def parse(text: str, selectors: bool = True) -> Node:
    """The tree of a condition: ``not`` binds before ``and``, that before ``or``."""
    return _Parser(text, selectors).parse()


def names_of(node: Node) -> set[str]:
    match node:
        case Name(n):
            return {n}
        case And(args) | Or(args):
            return set().union(*map(names_of, args))
        case Not(arg):
            return names_of(arg)
    return set()


def combined(node_type: type, args: list) -> object | None:
    """A node of the arguments that are not empty; a sole argument stands for itself."""
    args = [a for a in args if a is not None]
    return None if not args else args[0] if len(args) == 1 else node_type(tuple(args))


def resolved(node: Node, names: list[str], leaf: Callable[[str], object | None]) -> object | None:
    """The tree with names replaced; empty parts vanish."""
    match node:
        case Name(n):
            if n not in names:
                raise ConditionError(f"the condition names {n!r}, which is not defined")
            return leaf(n)
        case Selector(every, _):
            return combined(And if every else Or, [leaf(n) for n in node.matching(names)])
        case And(args):
            return combined(And, [resolved(a, names, leaf) for a in args])
        case Or(args):
            return combined(Or, [resolved(a, names, leaf) for a in args])
        case Not(arg):
            inner = resolved(arg, names, leaf)
            return None if inner is None else Not(inner)
    raise ConditionError(f"unknown node {node}")
