"""Expressions lowered to values, with their subqueries.

Subqueries never see the outer row.  Each becomes a plan of its own that runs
once: a scalar subquery, a semi join, or the least and greatest of its rows,
which answer ANY and ALL for every outer row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import SqlError
from tessera.functions import values as v
from tessera.functions.values import Value
from tessera.plans.nodes import Binary, Call, Exists, Expr, Items, Literal, Name, Null, Select, Subquery, Unary, walk
from tessera.plans.render import render
from tessera.plans.scope import Frame, Scope, fresh

AGGREGATES = frozenset({"COUNT", "SUM", "AVG", "MIN", "MAX"})


def is_aggregate(e: Expr) -> bool:
    return isinstance(e, Call) and e.name.upper() in AGGREGATES


def has_aggregate(e: Expr) -> bool:
    return any(map(is_aggregate, walk(e)))


class Lowering:
    """``run`` plans a SELECT; ``strict`` names must be columns, others may stand for their own text."""

    def __init__(self, run: Callable[[Select], Frame], scope: Scope, strict: bool = False, aggregates: Mapping[str, Value] | None = None):
        self.run, self.scope, self.strict, self.aggregates = run, scope, strict, aggregates

    def value(self, e: Expr) -> Value:
        out = self._value(e)
        return replace(out, query=True) if any(isinstance(x, (Subquery, Exists)) for x in walk(e)) else out

    def _value(self, e: Expr) -> Value:
        match e:
            case Literal(text, quoted):
                return v.literal(text, quoted)
            case Null():
                return v.null()
            case Name(text):
                return self._name(text)
            case Call():
                return self._call(e)
            case Unary(op, operand):
                return v.unary(op, self.value(operand))
            case Subquery(select):
                return scalar(self._single(select))
            case Exists(select):
                found = self.run(select).df.limit(1).agg(F.count(F.lit(1)).alias("n"))
                return Value(v.BOOL, found.scalar() > 0, compound=True)
            case Binary():
                return self._binary(e)
            case Items():
                raise SqlError("A list is only allowed after IN")
        raise TypeError(e)

    def _name(self, text: str) -> Value:
        found = self.scope.value(text)
        if found is None:
            if self.strict:
                raise SqlError(f"Unknown column: {text}")
            return v.literal(text, True)
        return found

    def _call(self, e: Call) -> Value:
        if is_aggregate(e):
            found = (self.aggregates or {}).get(render(e))
            if found is None:
                raise SqlError(f"Aggregate is not allowed here: {render(e)}")
            return found
        if e.name.upper() == "NOW" and not e.args and not e.star:
            return Value(v.TEXT, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), compound=True)
        raise SqlError(f"Unsupported function: {e.name}")

    def _single(self, select: Select) -> Frame:
        frame = self.run(select)
        if len(frame.columns) != 1:
            raise SqlError("SELECT expression must return exactly one column")
        return frame

    def _binary(self, e: Binary) -> Value:
        left = self.value(e.left)
        if e.quantifier:
            return self._quantified(e, left)
        if e.op in ("IS", "IS NOT"):
            return Value(v.BOOL, left.is_null if e.op == "IS" else ~left.is_null, compound=True)
        if e.op in ("IN", "NOT IN"):
            if isinstance(e.right, Subquery):
                return self._among(e.op, left, self._single(e.right.select))
            return v.listed(e.op, left, [self.value(x) for x in e.right.items])
        right = self.value(e.right)
        if e.op == "&&":
            return Value(v.BOOL, left.test & right.test, compound=True)
        if e.op == "||":
            return Value(v.BOOL, left.test | right.test, compound=True)
        if e.op in ("LIKE", "REGEXP"):
            return v.matches(e.op, left, right)
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return v.compare(e.op, left, right)
        return v.arithmetic(e.op, left, right)

    def _among(self, op: str, left: Value, frame: Frame) -> Value:
        mine, theirs = keys(left, frame.columns[0].value)
        found = F.coalesce(mine.isin(frame.df.select(theirs.alias("k")).where("k IS NOT NULL")), F.lit(False))
        return Value(v.BOOL, ~left.is_null & (found if op == "IN" else ~found), compound=True)

    def _quantified(self, e: Binary, left: Value) -> Value:
        frame = self._single(e.right.select)
        if (e.op, e.quantifier) in (("=", "ANY"), ("!=", "ALL")):
            return self._among("IN" if e.quantifier == "ANY" else "NOT IN", left, frame)
        x, theirs = ranks(left, frame.columns[0].value)
        ends = frame.df.select(theirs.alias("r")).agg(F.struct(F.min("r").alias("low"), F.max("r").alias("high")).alias("ends")).scalar()
        low, high = ends["low"], ends["high"]
        order = {"<": (Column.__lt__, high, low), "<=": (Column.__le__, high, low), ">": (Column.__gt__, low, high), ">=": (Column.__ge__, low, high)}
        if e.quantifier == "ANY":
            return Value(v.BOOL, (low != x) | (high != x) if e.op == "!=" else order[e.op][0](x, order[e.op][1]), compound=True)
        holds = (low == x) & (high == x) if e.op == "=" else order[e.op][0](x, order[e.op][2])
        return Value(v.BOOL, F.coalesce(holds, ~left.is_null), compound=True)  # null ends: no rows, and ALL holds


def scalar(frame: Frame) -> Value:
    """The one value of a subquery; no row is an error, but only where an outer row asks for it."""
    inner = frame.columns[0].value
    row = frame.df.select(F.struct(inner.output.alias("v")).alias("row")).scalar()
    found = F.coalesce(row, F.raise_error(F.lit("SELECT expression returned no rows")))["v"]
    return Value(v.NUM if inner.kind == v.BOOL else v.DYN if inner.literal is not None and inner.kind != v.NUM else inner.kind, found, integral=inner.integral or inner.kind == v.BOOL, compound=True)


def _same(a: Value, b: Value) -> bool:
    return a.kind == b.kind and a.kind in (v.NUM, v.TEXT, v.TIME)


def keys(a: Value, b: Value) -> tuple[Column, Column]:
    """Columns that are equal where the values are."""
    if _same(a, b):
        return (a.output, b.output) if a.kind != v.NUM or a.integral == b.integral else (a.number, b.number)
    return a.key, b.key


def ranks(a: Value, b: Value) -> tuple[Column, Column]:
    """Columns that order as the values do; null for null."""
    if _same(a, b):
        return (a.output, b.output) if a.kind != v.NUM else (a.number, b.number)
    return a.dynamic_rank, b.dynamic_rank


def conjuncts(e: Expr | None) -> list[Expr]:
    if isinstance(e, Binary) and e.op == "&&":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def filtered(df: DataFrame, where: Expr | None, lowering: Lowering) -> DataFrame:
    """``df`` where the condition holds.

    A membership test that every row must pass is a semi or anti join on a key,
    hashed or merged at any size; the anti join needs no null-aware plan
    because nulls are taken out on both sides.
    """
    for e in conjuncts(where):
        side = None
        if isinstance(e, Binary) and isinstance(e.right, Subquery):
            test = (e.op, e.quantifier)
            side = "left_semi" if test in (("IN", None), ("=", "ANY")) else "left_anti" if test in (("NOT IN", None), ("!=", "ALL")) else None
        if side is None:
            df = df.where(lowering.value(e).test)
            continue
        left, frame = lowering.value(e.left), lowering._single(e.right.select)
        mine, theirs = keys(left, frame.columns[0].value)
        k, other = fresh("k"), fresh("k")
        named = df.withColumn(k, mine)
        if side == "left_anti":
            named = named.where(F.col(k).isNotNull())
        right = frame.df.select(theirs.alias(other)).where(F.col(other).isNotNull())
        df = named.join(right, F.col(k) == F.col(other), side).drop(k)
    return df
