"""Tables of a session: rows of text, and DataFrames with their types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SqlError
from tessera.functions.values import number_of
from tessera.plans.nodes import Relation
from tessera.plans.render import is_number
from tessera.sources.base import HIT, ORDER, Column, Store, Table, auto_place
from tessera.sources.files import FileStore
from tessera.sources.scratch import rewritten

#: Rows that the driver holds of a table; what is more lies on shared storage.
LOCAL_ROWS = 10_000
_AFTER = 1 << 62


@dataclass
class _Held:
    columns: tuple[Column, ...]
    rows: list[list[str | None]] = field(default_factory=list)
    df: DataFrame | None = None  # rows that come before ``rows``


class MemoryStore(Store):
    """Tables by name; a path is read from disk by the file store."""

    def __init__(self, spark: SparkSession, root: str = "."):
        self.spark, self.files = spark, FileStore(spark, root)
        self.tables: dict[str, _Held] = {}
        self.typed: dict[str, DataFrame] = {}
        self.views: dict[str, str] = {}

    def register(self, name: str, df: DataFrame) -> None:
        """A table with types; it can be queried, and read again at each query."""
        self.typed[name] = df

    def default_alias(self, table: Relation) -> str:
        return self.files.default_alias(table)

    def _held(self, table: Relation) -> _Held:
        if table.name not in self.tables:
            raise SqlError(f"Tables with types are read-only: {table.name}" if table.name in self.typed else f"Table does not exist: {table.name}")
        return self.tables[table.name]

    def has_table(self, table: Relation) -> bool:
        return self.files.has_table(table) if table.is_path else table.name in self.tables or table.name in self.typed

    def describe(self, table: Relation) -> tuple[Column, ...]:
        if table.is_path:
            return self.files.describe(table)
        if table.name in self.typed:
            return tuple(Column(n) for n in self.typed[table.name].columns)
        return self._held(table).columns

    def read(self, table: Relation) -> Table:
        if table.is_path:
            return self.files.read(table)
        if table.name in self.typed:
            df = self.typed[table.name]
            return Table(self.describe(table), df.toDF(*[f"c{k}" for k in range(len(df.columns))]), False, False)
        held = self._held(table)
        schema = T.StructType([*[T.StructField(f"c{k}", T.StringType()) for k in range(len(held.columns))], T.StructField(ORDER, T.LongType())])
        df = self.spark.createDataFrame([(*row, k + _AFTER) for k, row in enumerate(held.rows)], schema)
        return Table(held.columns, df if held.df is None else held.df.unionByName(df))

    def save(self, table: Relation, columns: Sequence[Column], df: DataFrame | None) -> None:
        if table.is_path:
            return self.files.save(table, columns, df)
        held = _Held(tuple(columns))
        if df is not None:
            self._fill(held, df.withColumn(HIT, F.lit(False)), False)
        self.tables[table.name] = held
        return None

    def _fill(self, held: _Held, df: DataFrame, drop_hits: bool) -> int:
        """The rows of ``df``, in order, and how many are hits."""
        names = [f"c{k}" for k in range(len(held.columns))]
        rows = df.select(*names, ORDER, HIT).orderBy(ORDER).limit(LOCAL_ROWS + 1).collect()
        if len(rows) <= LOCAL_ROWS:
            held.rows = [list(r[:-2]) for r in rows if not (drop_hits and r[HIT])]
            return sum(r[HIT] for r in rows)
        kept = rewritten(df.select(*names, ORDER, HIT).orderBy(ORDER).withColumn(ORDER, F.monotonically_increasing_id()))
        held.df = (kept.where(~F.col(HIT)) if drop_hits else kept).drop(HIT)
        return kept.where(HIT).count()

    def change(self, table: Relation, columns: Sequence[Column], df: DataFrame, drop_hits: bool) -> int:
        if table.is_path:
            return self.files.change(table, columns, df, drop_hits)
        held = _Held(tuple(columns))
        affected = self._fill(held, df, drop_hits)
        if affected:
            self.tables[table.name] = held
        return affected

    def append(self, table: Relation, row: list[str | None]) -> None:
        if table.is_path:
            return self.files.append(table, row)
        held = self._held(table)
        held.rows.append(row)
        if len(held.rows) > LOCAL_ROWS:
            held.df = rewritten(self.read(table).df.orderBy(ORDER).withColumn(ORDER, F.monotonically_increasing_id()))
            held.rows = []
        return None

    def next_number(self, table: Relation) -> int:
        if table.is_path:
            return self.files.next_number(table)
        held = self._held(table)
        at = auto_place(held.columns)
        most = max((float(r[at]) for r in held.rows if r[at] and is_number(r[at])), default=0.0)
        if held.df is not None:
            most = max(most, held.df.agg(F.max(number_of(F.col(f"c{at}")))).first()[0] or 0.0)
        return int(most) + 1

    def drop(self, table: Relation) -> None:
        if table.is_path:
            return self.files.drop(table)
        self._held(table)
        del self.tables[table.name]
        return None

    def has_view(self, view: Relation) -> bool:
        return self.files.has_view(view) if view.is_path else view.name in self.views

    def view_text(self, view: Relation) -> str:
        if view.is_path:
            return self.files.view_text(view)
        if view.name not in self.views:
            raise SqlError(f"View does not exist: {view.name}")
        return self.views[view.name]

    def put_view(self, view: Relation, text: str) -> None:
        if view.is_path:
            self.files.put_view(view, text)
        else:
            self.views[view.name] = text

    def drop_view(self, view: Relation) -> None:
        if view.is_path:
            self.files.drop_view(view)
        elif self.views.pop(view.name, None) is None:
            raise SqlError(f"View does not exist: {view.name}")
