"""SELECT lowered to a DataFrame.

The plan is declared, not scheduled: sources are multiplied and the condition
filters the product, which Catalyst turns into joins and pushed filters.
Helper columns carry the dialect's row order only where a table has one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.errors import SqlError
from tessera.functions import values as v
from tessera.functions.values import Value
from tessera.operators.expressions import Lowering, filtered, has_aggregate, is_aggregate
from tessera.plans.nodes import Call, Expr, Name, Relation, Select, Source, walk
from tessera.plans.parser import parse
from tessera.plans.render import render
from tessera.plans.scope import Column, Frame, GroupScope, Scope, fresh
from tessera.sources.base import ORDER, Store


class Planner:
    """Plans queries over a store; views being expanded are remembered, so that a cycle is found."""

    def __init__(self, store: Store):
        self.store, self.open_views = store, []

    def select(self, s: Select) -> Frame:
        names, frames = self._sources(s.sources)
        scope = Scope([(n, f.columns) for n, f in zip(names, frames)])
        joined = frames[0].df
        for f in frames[1:]:
            joined = joined.crossJoin(f.df)
        order = tuple(o for f in frames for o in f.order)
        dynamic = any(f.dynamic for f in frames)
        df = filtered(joined, s.where, Lowering(self.select, scope))
        if s.having is not None and not s.group_by:
            raise SqlError("HAVING requires GROUP BY")
        rows = Frame(df, (), order, dynamic, len(frames) == 1 and frames[0].is_sorted)
        if s.group_by:
            return self._grouped(s, scope, rows)
        if any(has_aggregate(p.expr) for p in s.projections):
            return self._aggregated(s, scope, rows)
        lowering = Lowering(self.select, scope, strict=True)
        if s.projections:
            outputs = [(p.alias or render(p.expr), lowering.value(p.expr)) for p in s.projections]
        else:
            outputs = [(f"{n}.{c.name}" if len(names) > 1 else c.name, c.value) for n, f in zip(names, frames) for c in f.columns]
        return self._finished(s, rows, outputs, lowering)

    # Sources.

    def _sources(self, sources: Sequence[Source]) -> tuple[list[str], list[Frame]]:
        names, frames = [], []
        for source in sources:
            if source.select is not None:
                if not source.alias:
                    raise SqlError("FROM subquery requires an alias")
                name, frame = source.alias, self.select(source.select)
            else:
                name, frame = source.alias or self.store.default_alias(source.relation), self.relation(source.relation)
            if name.lower() in (n.lower() for n in names):
                raise SqlError(f"Duplicate source name: {name}")
            names.append(name)
            frames.append(_renamed(frame))
        return names, frames

    def relation(self, relation: Relation) -> Frame:
        """A table, or the rows of a view."""
        if self.store.has_view(relation):
            if relation.name in self.open_views:
                raise SqlError(f"View refers to itself: {' -> '.join([*self.open_views, relation.name])}")
            self.open_views.append(relation.name)
            try:
                statement = parse(self.store.view_text(relation))
                if not isinstance(statement, Select):
                    raise SqlError(f"View is no SELECT: {relation.name}")
                return self.select(statement)
            finally:
                self.open_views.pop()
        table = self.store.read(relation)
        types = table.df.schema
        columns = [Column(c.name, v.of_column(F.col(f"c{k}"), types[f"c{k}"].dataType, table.dynamic)) for k, c in enumerate(table.columns)]
        return Frame(table.df, tuple(columns), ((ORDER, False),) if table.ordered else (), table.dynamic)

    # Rows to results.

    def _finished(self, s: Select, rows: Frame, outputs: list[tuple[str, Value]], lowering: Lowering) -> Frame:
        """Sort, DISTINCT, OFFSET and LIMIT, in that order, over projected rows."""
        ids = [fresh("c") for _ in outputs]
        shown = [x.text if rows.dynamic else x.output for _, x in outputs]
        keys = [(fresh("s"), o.descending, lowering.value(o.expr).rank) for o in s.order_by]
        df = rows.df.select(*[c.alias(i) for i, c in zip(ids, shown)], *[c.alias(i) for i, _, c in keys], *[c for c, _ in rows.order])
        columns = tuple(Column(n, _as_column(x, i, rows.dynamic)) for (n, x), i in zip(outputs, ids))
        order = (*((i, down) for i, down, _ in keys), *rows.order)
        out = Frame(df, columns, order, rows.dynamic, rows.is_sorted and not keys)
        shown_exprs = {p.expr for p in s.projections}
        settled = [i for (i, _, _), o in zip(keys, s.order_by) if o.expr in shown_exprs or not s.projections]
        return _cut(s, _distinct(out, ids, settled) if s.distinct else out)

    def _grouped(self, s: Select, scope: Scope, rows: Frame) -> Frame:
        if not s.projections:
            raise SqlError("SELECT * cannot be grouped")
        keys: dict[int, Value] = {}
        grouping: list[SparkColumn] = []
        for e in s.group_by:
            if not isinstance(e, Name):
                raise SqlError("GROUP BY takes columns only")
            found = scope.column(e.text)
            if found is None:
                raise SqlError(f"Unknown column: {e.text}")
            if id(found) not in keys:
                name = fresh("g")
                grouping.append((found.value.text if rows.dynamic else found.value.output).alias(name))
                keys[id(found)] = _as_column(found.value, name, rows.dynamic)
        asked = [p.expr for p in s.projections] + [o.expr for o in s.order_by] + ([s.having] if s.having else [])
        made, aggregates = self._aggregates(asked, scope, rows.dynamic)
        first = fresh("o")
        # The order of groups is that of their first rows.
        extra = [F.min(F.struct(*[c for c, _ in rows.order])).alias(first)] if rows.order and not any(down for _, down in rows.order) else []
        df = rows.df.groupBy(*grouping).agg(*(made + extra or [F.count(F.lit(1)).alias(fresh())]))
        lowering = Lowering(self.select, GroupScope(scope, keys), strict=True, aggregates=aggregates)
        if s.having is not None:
            df = filtered(df, s.having, lowering)
        grouped = Frame(df, (), ((first, False),) if extra else (), rows.dynamic)
        return self._finished(s, grouped, [(p.alias or render(p.expr), lowering.value(p.expr)) for p in s.projections], lowering)

    def _aggregated(self, s: Select, scope: Scope, rows: Frame) -> Frame:
        """One row; what shapes rows (ORDER BY, DISTINCT, OFFSET, LIMIT) comes before the aggregates."""
        if not all(is_aggregate(p.expr) for p in s.projections):
            raise SqlError("Without GROUP BY every projection must be an aggregate")
        df = rows.df
        if s.distinct or s.limit is not None or s.offset is not None:
            lowering = Lowering(self.select, scope, strict=True)
            keys = [(fresh("s"), o.descending, lowering.value(o.expr).rank) for o in s.order_by]
            names = [x for x in df.columns if x not in {c for c, _ in rows.order}]
            shaped = Frame(df.select(*names, *[c.alias(i) for i, _, c in keys], *[c for c, _ in rows.order]), (), (*((i, down) for i, down, _ in keys), *rows.order), rows.dynamic)
            df = _cut(s, _distinct(shaped, names, [i for i, _, _ in keys]) if s.distinct else shaped).df
        else:
            for o in s.order_by:
                Lowering(self.select, scope, strict=True).value(o.expr)
        made, aggregates = self._aggregates([p.expr for p in s.projections], scope, rows.dynamic)
        df = df.agg(*made)
        outputs = [(p.alias or render(p.expr), aggregates[render(p.expr)]) for p in s.projections]
        ids = [fresh("c") for _ in outputs]
        df = df.select(*[(x.text if rows.dynamic else x.output).alias(i) for i, (_, x) in zip(ids, outputs)])
        return Frame(df, tuple(Column(n, _as_column(x, i, rows.dynamic)) for (n, x), i in zip(outputs, ids)), (), rows.dynamic, True)

    def _aggregates(self, exprs: Sequence[Expr], scope: Scope, dynamic: bool) -> tuple[list[SparkColumn], dict[str, Value]]:
        """Spark aggregates, each once, and the value that stands for each written one."""
        made, out = [], {}
        lowering = Lowering(self.select, scope, strict=True)
        for e in (x for root in exprs for x in walk(root) if is_aggregate(x)):
            text = render(e)
            if text not in out:
                name = fresh("a")
                column, value = _aggregate(e, lowering, name, dynamic)
                made.append(column.alias(name))
                out[text] = value
        return made, out


def _aggregate(e: Call, lowering: Lowering, name: str, dynamic: bool) -> tuple[SparkColumn, Value]:
    kind, here = e.name.upper(), F.col(name)
    if e.star:
        if kind != "COUNT":
            raise SqlError(f"{kind} does not take *")
        return F.count(F.lit(1)), Value(v.NUM, here, integral=True)
    if len(e.args) != 1:
        raise SqlError(f"{kind} takes one argument")
    if has_aggregate(e.args[0]):
        raise SqlError("Aggregates cannot be nested")
    x = lowering.value(e.args[0])
    texts = x.kind in (v.TEXT, v.DYN)
    told = (lambda c: F.when(x.text != "", c)) if texts else (lambda c: c)  # the empty text counts as nothing
    if kind == "COUNT":
        return F.count(told(x.output)), Value(v.NUM, here, integral=True)
    if kind in ("SUM", "AVG"):
        total = F.sum if kind == "SUM" else F.avg
        return F.coalesce(total(told(x.operand)), F.lit(0.0)), Value(v.NUM, here)
    if x.kind == v.DYN:
        best = F.min_by if kind == "MIN" else F.max_by
        return F.coalesce(best(x.text, told(x.rank)), F.lit("") if dynamic else F.lit(None)), Value(v.DYN, here)
    best = (F.min if kind == "MIN" else F.max)(told(x.output))
    if dynamic and x.kind == v.TEXT:
        return F.coalesce(best, F.lit("")), Value(v.DYN, here)
    if dynamic:
        return F.coalesce((_as_column(x, "", False, best)).text, F.lit("")), Value(v.DYN, here)
    return best, Value(v.NUM if x.kind == v.BOOL else x.kind, here, integral=x.integral or x.kind == v.BOOL)


def _as_column(x: Value, name: str, dynamic: bool, col: SparkColumn | None = None) -> Value:
    """The value of a projected column: text where rows are dynamic, else of the same kind."""
    col = F.col(name) if col is None else col
    if dynamic:
        return Value(v.DYN, col)
    if x.kind == v.BOOL:
        return Value(v.NUM, col, integral=True)
    return Value(v.TEXT if x.kind == v.NULL else x.kind, col, integral=x.integral)


def _renamed(frame: Frame) -> Frame:
    """The frame under names of its own, so that a source can appear twice."""
    names = {c: fresh("r") for c in frame.df.columns}
    columns = []
    picked = []
    for c in frame.columns:
        name = fresh("r")
        picked.append(c.value.col.alias(name))
        columns.append(Column(c.name, replace(c.value, col=F.col(name))))
    df = frame.df.select(*picked, *[F.col(c).alias(names[c]) for c, _ in frame.order])
    return Frame(df, tuple(columns), tuple((names[c], down) for c, down in frame.order), frame.dynamic, frame.is_sorted)


def _distinct(frame: Frame, names: Sequence[str], settled: Sequence[str]) -> Frame:
    """One row of each kind, the first in order; what order it had may be by columns that are not shown.

    ``settled`` helpers are functions of what is shown, so any row of a kind has them.
    """
    if not frame.order:
        return replace(frame, df=frame.df.select(*names).distinct(), is_sorted=False)
    open_ = [(c, down) for c, down in frame.order if c not in settled]
    if any(down for _, down in open_) and not all(down for _, down in open_):  # mixed directions have no least struct
        place = fresh("n")
        first = W.partitionBy(*names).orderBy(*frame.sort_keys())
        df = frame.df.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
        return replace(frame, df=df, is_sorted=False)
    best, end = fresh("d"), F.max if any(down for _, down in open_) else F.min
    made = [F.first(c).alias(c) for c in settled if c in {x for x, _ in frame.order}]
    made += [end(F.struct(*[c for c, _ in open_])).alias(best)] if open_ else []
    df = frame.df.groupBy(*names).agg(*made)
    return replace(frame, df=df.select(*names, *[F.col(c) if c in settled else F.col(f"{best}.{c}").alias(c) for c, _ in frame.order]), is_sorted=False)


def _cut(s: Select, frame: Frame) -> Frame:
    """OFFSET, then LIMIT, over rows in their order."""
    if s.limit is None and s.offset is None:
        return replace(frame, is_sorted=frame.is_sorted and not s.order_by)
    df: DataFrame = frame.df
    if frame.order:
        df = df.orderBy(*frame.sort_keys())
    if s.offset:
        df = df.offset(s.offset)
    if s.limit is not None:
        df = df.limit(s.limit)
    return replace(frame, df=df, is_sorted=True)


def sorted_rows(frame: Frame) -> DataFrame:
    """The frame's rows in order, under the names of the query."""
    df = frame.df.orderBy(*frame.sort_keys()) if frame.order and not frame.is_sorted else frame.df
    return df.select(*[c.value.col for c in frame.columns]).toDF(*[c.name for c in frame.columns])

