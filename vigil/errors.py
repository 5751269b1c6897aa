"""Errors of rules, pipelines and planning."""


class VigilError(Exception):
    """Base of all errors; ``source`` says which rule or file it is about."""

    def __init__(self, message: str, source: object | None = None) -> None:
        super().__init__(message)
        self.source = source

    def __str__(self) -> str:
        text = super().__str__()
        return f"{text} (in {self.source})" if self.source else text


class RuleError(VigilError):
    """A rule, filter or correlation is not well formed."""


class ValueTypeError(RuleError):
    """A value or modifier does not fit."""


class ConditionError(RuleError):
    """A condition does not parse or names something unknown."""


class ReferenceError_(RuleError):
    """A rule reference does not resolve, or references form a cycle."""


class PipelineError(VigilError):
    """A processing pipeline is not well formed."""


class TransformationError(VigilError):
    """A transformation failed or was told to fail."""


class SecurityError(VigilError):
    """Something that must be allowed explicitly was not."""


class PlanError(VigilError):
    """A rule has no execution on the given tables."""
