"""Rule filters: an extra predicate for the rules that they apply to."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from vigil.errors import RuleError, VigilError
from vigil.plans.condition import And, Name, Not, Or, Selector, parse, resolved
from vigil.plans.rules import AnyRule, Detection, LogSource, Meta, Rule, parse_detections


@dataclass
class Filter(AnyRule):
    logsource: LogSource = field(default_factory=LogSource)
    rules: list[str] | None = None  # None: any rule
    detections: dict[str, Detection] = field(default_factory=dict)
    condition: str = ""

    @classmethod
    def from_dict(cls, data: dict, collect_errors: bool = False, source: object = None) -> Filter:
        errors: list[VigilError] = []
        out = cls(Meta.parse(data, ("logsource", "filter"), errors), errors, source)
        try:
            out.logsource = LogSource.from_dict(data.get("logsource"))
            body = data.get("filter")
            if not isinstance(body, dict):
                raise RuleError("a filter must be a map")
            if "rules" not in body:
                raise RuleError("a filter needs rules")
            rules = body["rules"]
            if isinstance(rules, str):
                out.rules = None if rules.lower() == "any" else [rules]
            elif isinstance(rules, list) and rules:
                out.rules = [str(r) for r in rules]
            else:
                raise RuleError("the rules of a filter must be a list or any")
            out.detections, conditions = parse_detections({k: v for k, v in body.items() if k != "rules"})
            if len(conditions) != 1:
                raise RuleError("a filter needs one condition")
            out.condition = conditions[0]
        except VigilError as e:
            errors.append(e)
        for e in errors:
            e.source = e.source or source or out.meta.title
        if errors and not collect_errors:
            raise errors[0]
        return out

    def applies_to(self, rule: AnyRule) -> bool:
        if not isinstance(rule, Rule) or rule.logsource not in self.logsource:
            return False
        return self.rules is None or any(rule.is_called(r) for r in self.rules)

    def tree(self) -> object | None:
        return resolved(parse(self.condition), list(self.detections), lambda n: self.detections[n].tree())

    def apply(self, rule: AnyRule) -> AnyRule:
        """The rule, or a copy that also asks for the filter's condition."""
        if not self.applies_to(rule):
            return rule
        out = rule.copy()
        # the detections come along, under names of their own, so that pipelines rewrite them too
        prefix = f"_filter{sum(n.startswith('_filter') for n in out.detections)}_"
        names = {n: prefix + n for n in self.detections}
        condition = _renamed(self.condition, names)
        out.detections |= {names[n]: d for n, d in copy.deepcopy(self.detections).items()}
        if condition is not None:
            out.conditions = [f"({c}) and ({condition})" for c in out.conditions]
        return out


def _renamed(condition: str, names: dict[str, str]) -> str | None:
    """The condition with its names replaced; selectors become the names that they match, and vanish with none, as do empty parts."""

    def joined(word: str, parts: list[str | None]) -> str | None:
        found = [p for p in parts if p is not None]
        return "(" + f" {word} ".join(found) + ")" if found else None

    def text(node: object) -> str | None:
        match node:
            case Name(n):
                return names.get(n, n)
            case Selector(every, _):
                return joined("and" if every else "or", [names[n] for n in node.matching(list(names))])
            case Not(arg):
                inner = text(arg)
                return None if inner is None else f"not {inner}"
            case And(args) | Or(args):
                return joined("and" if isinstance(node, And) else "or", list(map(text, args)))
        raise RuleError(f"unknown node {node}")

    return text(parse(condition))
