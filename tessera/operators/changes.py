"""Statements that change tables and views.

Rows are changed by reading a table, transforming it and writing it anew; the
store swaps the new table in.  An insert only appends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.errors import SqlError
from tessera.functions import values as v
from tessera.functions.values import Value, number_of
from tessera.operators.expressions import Lowering
from tessera.operators.select import Planner, sorted_rows
from tessera.plans import nodes as n
from tessera.plans.parser import parse_expression
from tessera.plans.render import render, render_select
from tessera.plans.scope import Column as Named
from tessera.plans.scope import Scope, TableScope
from tessera.sources.base import HIT, ORDER, Column, Store, Table, auto_place, place, without_auto

#: Rows, as a power of two, that are numbered in one task.
SPAN_BITS = 20


class Changes:
    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store

    def _planner(self) -> Planner:
        return Planner(self.store)

    def run(self, statement) -> tuple[int, str]:
        """Rows affected, and what to say."""
        return getattr(self, f"_{type(statement).__name__.lower()}")(statement)

    def _only_table(self, table: n.Relation) -> None:
        if self.store.has_view(table) and not self.store.has_table(table):
            raise SqlError(f"Views are read-only: {table.name}")
        if not self.store.has_table(table):
            raise SqlError(f"Table does not exist: {table.name}")

    def _to_change(self, table: n.Relation) -> Table:
        self._only_table(table)
        found = self.store.read(table)
        if not found.dynamic:
            raise SqlError(f"Tables with types are read-only: {table.name}")
        return found

    # Values without a row.

    def _text(self, e: n.Expr) -> str | None:
        value = Lowering(self._planner().select, Scope()).value(e)
        if value.kind == v.NULL:
            return None
        if value.literal is not None:
            return value.literal
        return self.spark.range(1).select(value.text.alias("v")).first()[0]

    # Definitions.

    def _createtable(self, s: n.CreateTable) -> tuple[int, str]:
        if self.store.has_table(s.table) or self.store.has_view(s.table):
            raise SqlError(f"Table or view already exists: {s.table.name}")
        self.store.save(s.table, [_column(c) for c in s.columns], None)
        return 0, f"Created table '{s.table.name}'"

    def _putview(self, s: n.PutView) -> tuple[int, str]:
        old = self.store.view_text(s.view) if self.store.has_view(s.view) else None
        if s.replace and old is None:
            raise SqlError(f"View does not exist: {s.view.name}")
        if not s.replace and (old is not None or self.store.has_table(s.view)):
            raise SqlError(f"Table or view already exists: {s.view.name}")
        self.store.put_view(s.view, render_select(s.select, stored=True))
        try:  # planned, cycles included, and run over all rows: a view that fails on any is not kept
            sorted_rows(self._planner().relation(s.view)).write.format("noop").mode("overwrite").save()
        except Exception:
            self.store.drop_view(s.view) if old is None else self.store.put_view(s.view, old)
            raise
        return 0, f"{'Altered' if s.replace else 'Created'} view '{s.view.name}'"

    def _drop(self, s: n.Drop) -> tuple[int, str]:
        if s.is_view:
            if not self.store.has_view(s.target) and self.store.has_table(s.target):
                raise SqlError(f"Not a view: {s.target.name}")
            self.store.drop_view(s.target)
            return 0, f"Dropped view '{s.target.name}'"
        if self.store.has_view(s.target) and not self.store.has_table(s.target):
            raise SqlError(f"Not a table: {s.target.name}")
        self.store.drop(s.target)
        return 0, f"Dropped table '{s.target.name}'"

    def _altertable(self, s: n.AlterTable) -> tuple[int, str]:
        table = self._to_change(s.table)
        columns, df = list(table.columns), table.df
        names = [c.name for c in columns]
        if s.action == "add":
            if s.column.lower() in (x.lower() for x in names):
                raise SqlError(f"Column already exists: {s.column}")
            if s.definition.auto_increment and auto_place(columns) is not None:
                raise SqlError("A table has one AUTO_INCREMENT column")
            new = _column(s.definition)
            value = self._row_value(s.table, columns, s.definition.default) if s.definition.default else v.literal("", True)
            columns.append(new)
            df = df.withColumn(f"c{len(names)}", value.text if value.kind != v.NULL else F.lit(None).cast("string"))
            if new.auto_increment:
                df = _numbered(df, len(names))
        else:
            at = place(columns, s.column)
            if s.action == "drop":
                if len(columns) == 1:
                    raise SqlError("The last column cannot be dropped")
                columns.pop(at)
                kept = [f"c{k}" for k in range(len(names)) if k != at]
                df = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)], ORDER)
            elif s.action == "rename":
                if s.new_name in names:
                    raise SqlError(f"Column already exists: {s.new_name}")
                columns[at] = replace(columns[at], name=s.new_name)
            elif s.action == "set default":
                columns[at] = replace(columns[at], default=render(s.default, stored=True))
            elif s.action == "drop default":
                columns[at] = replace(columns[at], default=None)
            elif s.action == "set auto":
                columns = list(without_auto(columns))
                columns[at] = replace(columns[at], auto_increment=True)
                df = _numbered(df, at)
            else:
                columns[at] = replace(columns[at], auto_increment=False)
        self.store.save(s.table, columns, df)
        return 0, f"Altered table '{s.table.name}'"

    # Rows.

    def _scope(self, table: n.Relation, columns: Sequence[Column]) -> TableScope:
        named = [Named(c.name, Value(v.DYN, F.col(f"c{k}"))) for k, c in enumerate(columns)]
        return TableScope([(self.store.default_alias(table), named)])

    def _row_value(self, table: n.Relation, columns: Sequence[Column], e: n.Expr) -> Value:
        return Lowering(self._planner().select, self._scope(table, columns)).value(e)

    def _insert(self, s: n.Insert) -> tuple[int, str]:
        self._only_table(s.table)
        columns = self.store.describe(s.table)
        given: dict[int, str | None] = {}
        if s.columns is not None:
            if len(s.columns) != len(s.values):
                raise SqlError("INSERT has as many values as columns")
            places = [place(columns, c) for c in s.columns]
        else:
            if len(s.values) > len(columns):
                raise SqlError("INSERT has more values than columns")
            places = list(range(len(s.values)))
            if s.values and any(c.default is None for c in columns[len(s.values) :]):
                raise SqlError("INSERT without a column list needs a value for every column without DEFAULT")
        for at, e in zip(places, s.values):
            given[at] = self._text(e)
        row = [given[k] if k in given else "" if c.default is None else self._text(parse_expression(c.default)) for k, c in enumerate(columns)]
        auto = auto_place(columns)
        if auto is not None and row[auto] == "":
            row[auto] = str(self.store.next_number(s.table))
        self.store.append(s.table, row)
        return 1, f"Inserted 1 row into '{s.table.name}'"

    def _update(self, s: n.Update) -> tuple[int, str]:
        table = self._to_change(s.table)
        places = [place(table.columns, c) for c, _ in s.assignments]
        hit = self._row_value(s.table, table.columns, s.where).truth if s.where else F.lit(True)
        df = table.df.withColumn(HIT, hit)
        for at, (_, e) in zip(places, s.assignments):  # each sees what those before it have set
            value = self._row_value(s.table, table.columns, e)
            text = F.lit(None).cast("string") if value.kind == v.NULL else value.text
            df = df.withColumn(f"c{at}", F.when(F.col(HIT), text).otherwise(F.col(f"c{at}")))
        affected = self.store.change(s.table, table.columns, df, drop_hits=False)
        return affected, f"Updated {affected} row(s) in '{s.table.name}'"

    def _delete(self, s: n.Delete) -> tuple[int, str]:
        table = self._to_change(s.table)
        hit = self._row_value(s.table, table.columns, s.where).truth if s.where else F.lit(True)
        affected = self.store.change(s.table, table.columns, table.df.withColumn(HIT, hit), drop_hits=True)
        return affected, f"Deleted {affected} row(s) from '{s.table.name}'"


def _column(c: n.ColumnDef) -> Column:
    return Column(c.name, c.auto_increment, render(c.default, stored=True) if c.default else None)


def _numbered(df: DataFrame, at: int) -> DataFrame:
    """Blank values of a column filled, in order, with the numbers after its greatest.

    Rows are numbered within spans of the order, of at most ``2 ** SPAN_BITS``
    rows each, and every span after those before it: only the spans' counts
    come together.
    """
    name, span, before = f"c{at}", "_span", "_before"
    blank = F.coalesce(F.col(name), F.lit("")) == ""
    most = F.coalesce(df.agg(F.max(number_of(F.col(name))).alias("m")).scalar(), F.lit(0.0)).cast("long")
    rows = df.withColumn(span, F.shiftright(ORDER, SPAN_BITS))
    counts = rows.groupBy(span).agg(F.count_if(blank).alias("n"))
    earlier = F.sum("n").over(W.orderBy(span).rowsBetween(W.unboundedPreceding, -1))
    spans = counts.select(span, F.coalesce(earlier, F.lit(0)).alias(before))
    rank = F.row_number().over(W.partitionBy(span, blank).orderBy(ORDER))
    filled = F.when(blank, (most + F.col(before) + rank).cast("string")).otherwise(F.col(name))
    return rows.join(spans, span).withColumn(name, filled).drop(span, before)
