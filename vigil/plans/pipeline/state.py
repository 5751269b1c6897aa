"""What a pipeline knows while it rewrites one rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from vigil.plans.correlation import Correlation
from vigil.plans.rules import AnyRule, Detection, Item, Rule


@dataclass
class State:
    """Variables, state keys, names of applied items, and where fields went."""

    rule: AnyRule
    vars: dict = field(default_factory=dict)
    values: dict = field(default_factory=dict)
    applied: set[str] = field(default_factory=set)
    field_applied: dict[str | None, set[str]] = field(default_factory=dict)
    mapped: dict[str | None, list[str]] = field(default_factory=dict)  # original: targets
    targets: set[str] = field(default_factory=set)
    referenced: list[Rule] = field(default_factory=list)  # rules that a correlation refers to

    def track(self, old: str | None, new: list[str], item_id: str) -> None:
        origin = next((o for o, ts in self.mapped.items() if old in ts and o != old), old)
        kept = [t for t in self.mapped.get(origin, []) if t != old]
        self.mapped[origin] = kept + [n for n in new if n not in kept]
        self.targets.update(new)
        for n in new:
            self.field_applied.setdefault(n, set()).update(self.field_applied.get(old, set()) | {item_id})

    @property
    def detections(self) -> list[Detection]:
        return list(self.rule.detections.values()) if isinstance(self.rule, Rule) else []

    def items(self) -> list[Item]:
        return [i for d in self.detections for i in d.each_item()]

    def logsources(self) -> list:
        if isinstance(self.rule, Rule):
            return [self.rule.logsource]
        return [r.logsource for r in self.referenced] if isinstance(self.rule, Correlation) else []
