"""Which table holds the events of a log source."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vigil.errors import PlanError
from vigil.plans.compile import Fields
from vigil.plans.rules import LogSource


@dataclass
class Source:
    """A table of events, batch or streaming, and how rules see it."""

    logsource: LogSource
    load: Callable[[], DataFrame]
    name: str = ""
    time: str | None = None  # the column of event times
    json_columns: tuple[str, ...] = ()
    keyword_columns: tuple[str, ...] = ()
    derived: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    strict: bool = False
    _frame: DataFrame | None = None

    @property
    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = self.load()
        return self._frame

    @property
    def fields(self) -> Fields:
        return Fields(self.frame.schema, self.json_columns, self.keyword_columns, self.derived, self.strict)


class Catalog:
    """The most specific source whose log source contains that of a rule."""

    def __init__(self, sources: list[Source] | None = None) -> None:
        self.sources = list(sources or [])

    def add(self, table: DataFrame | Callable[[], DataFrame], category: str | None = None, product: str | None = None, service: str | None = None, **options: object) -> Source:
        load = (lambda: table) if isinstance(table, DataFrame) else table
        source = Source(LogSource(category, product, service), load, **options)  # type: ignore[arg-type]
        self.sources.append(source)
        return source

    def find(self, logsource: LogSource, name: str | None = None) -> Source:
        """By name if one is given, as pipelines do through their state; else by log source."""
        if name is not None:
            for s in self.sources:
                if s.name == name:
                    return s
            raise PlanError(f"no source is named {name!r}")
        fitting = [s for s in self.sources if logsource in s.logsource]
        if not fitting:
            raise PlanError(f"no source for log source {logsource}")
        return max(fitting, key=lambda s: sum(x is not None for x in s.logsource.key))


def files(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, stream: bool = False, **options: object) -> Callable[[], DataFrame]:
    """A loader of files of any format Spark reads; ``stream`` reads them as they arrive."""

    def load() -> DataFrame:
        reader = (spark.readStream if stream else spark.read).format(format).options(**options)
        return (reader.schema(schema) if schema else reader).load(path)

    return load
