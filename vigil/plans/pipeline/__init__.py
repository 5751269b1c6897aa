"""Processing pipelines: conditional rewriting of rules before planning, and of results after it."""

from vigil.plans.pipeline.core import Pipeline, PostItem, RuleItem, State
from vigil.plans.pipeline.resolver import Resolver, bundled

__all__ = ["Pipeline", "PostItem", "Resolver", "RuleItem", "State", "bundled"]
