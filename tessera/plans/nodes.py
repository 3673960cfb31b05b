"""Syntax trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Literal(Expr):
    text: str
    quoted: bool


@dataclass(frozen=True)
class Null(Expr):
    pass


@dataclass(frozen=True)
class Name(Expr):
    """A column, bare or as ``source.column``; in some places its own text."""

    text: str


@dataclass(frozen=True)
class Items(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Subquery(Expr):
    select: Select


@dataclass(frozen=True)
class Exists(Expr):
    select: Select


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    star: bool = False


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    quantifier: str | None = None


@dataclass(frozen=True)
class Relation:
    """A stored table or view by name, or a file by path."""

    name: str
    is_path: bool = False


@dataclass(frozen=True)
class Source:
    relation: Relation | None
    select: Select | None
    alias: str | None


@dataclass(frozen=True)
class Projection:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    projections: tuple[Projection, ...]  # none: every column
    sources: tuple[Source, ...]
    distinct: bool = False
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    auto_increment: bool = False
    default: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    table: Relation
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class PutView:
    """CREATE VIEW, or ALTER VIEW if ``replace``."""

    view: Relation
    select: Select
    replace: bool = False


@dataclass(frozen=True)
class Drop:
    target: Relation
    is_view: bool = False


@dataclass(frozen=True)
class AlterTable:
    """``action``: add, drop, rename, set default, drop default, set auto, drop auto."""

    table: Relation
    action: str
    column: str = ""
    definition: ColumnDef | None = None
    new_name: str = ""
    default: Expr | None = None


@dataclass(frozen=True)
class Insert:
    table: Relation
    columns: tuple[str, ...] | None
    values: tuple[Expr, ...]


@dataclass(frozen=True)
class Update:
    table: Relation
    assignments: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: Relation
    where: Expr | None = None


Statement = Select | CreateTable | PutView | Drop | AlterTable | Insert | Update | Delete


def walk(root: Expr) -> Iterator[Expr]:
    """``root`` and the expressions below it, from left to right; subqueries are not entered."""
    yield root
    below: tuple[Expr, ...] = ()
    if isinstance(root, Unary):
        below = (root.operand,)
    elif isinstance(root, Binary):
        below = (root.left, root.right)
    elif isinstance(root, Call):
        below = root.args
    elif isinstance(root, Items):
        below = root.items
    for e in below:
        yield from walk(e)
