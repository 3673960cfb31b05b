"""The library's entry: statements in, results out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SqlError, reason
from tessera.operators.changes import Changes
from tessera.operators.select import Planner, sorted_rows
from tessera.plans.nodes import Select, Statement
from tessera.plans.parser import parse
from tessera.sources.base import Store
from tessera.sources.memory import MemoryStore
from tessera.streaming.rows import RowStream


@dataclass
class Result:
    """What a statement did.  A SELECT is lazy: ``df`` runs when it is read, ``affected_rows`` counts it."""

    success: bool
    kind: str
    text: str = ""
    changed: int = 0
    df: DataFrame | None = None
    error: str = ""

    @cached_property
    def affected_rows(self) -> int:
        return self.df.count() if self.df is not None else self.changed

    @property
    def message(self) -> str:
        return f"{self.affected_rows} row(s) selected" if self.df is not None else self.text

    @property
    def rows(self) -> RowStream:
        if self.df is None:
            raise SqlError(self.error or "The statement has no rows")
        return RowStream(self.df)


class Session:
    """Runs statements over a store, by default tables in memory."""

    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store = spark, store or MemoryStore(spark)

    def execute(self, statement: Statement) -> Result:
        kind = type(statement).__name__
        try:
            if isinstance(statement, Select):
                return Result(True, kind, df=sorted_rows(Planner(self.store).select(statement)))
            changed, text = Changes(self.spark, self.store).run(statement)
            return Result(True, kind, text, changed)
        except (SqlError, PySparkException, Py4JError, OSError) as e:
            return Result(False, kind, error=reason(e))

    def sql(self, text: str) -> Result:
        """Parse and run; a text that cannot be parsed raises, a statement that fails says so in its result."""
        return self.execute(parse(text))

    def table(self, text: str) -> DataFrame:
        """The DataFrame of a SELECT; failures raise."""
        result = self.sql(text)
        if result.df is None:
            raise SqlError(result.error or "The statement has no rows")
        return result.df
