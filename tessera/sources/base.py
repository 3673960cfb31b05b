"""What a table store offers, and how stored columns are written."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tessera.errors import SqlError
from tessera.plans.nodes import Relation

#: The hidden column that holds the order of stored rows.
ORDER = "_ord"
#: The hidden column that says which rows a change is about.
HIT = "_hit"
_STORED = re.compile(r"(?s)(?P<name>.*?)(?P<auto> AUTO_INCREMENT)?(?: DEFAULT\((?P<default>.*)\))?\Z")


@dataclass(frozen=True)
class Column:
    """A column; in a file its name carries the rest: ``name[ AUTO_INCREMENT][ DEFAULT(expression)]``."""

    name: str
    auto_increment: bool = False
    default: str | None = None

    @property
    def stored(self) -> str:
        return self.name + (" AUTO_INCREMENT" if self.auto_increment else "") + (f" DEFAULT({self.default})" if self.default is not None else "")

    @classmethod
    def parse(cls, stored: str) -> Column:
        m = _STORED.match(stored)
        return cls(m["name"], bool(m["auto"]), m["default"])


@dataclass(frozen=True)
class Table:
    """A table as read: ``df`` has its values in ``c0``, ``c1``, ... and, if rows have an order, ``_ord``.

    ``dynamic`` tables hold nothing but text.
    """

    columns: tuple[Column, ...]
    df: DataFrame
    dynamic: bool = True
    ordered: bool = True


def place(columns: Sequence[Column], name: str) -> int:
    """Where a column is; changes of tables ignore case."""
    for k, c in enumerate(columns):
        if c.name.lower() == name.lower():
            return k
    raise SqlError(f"Unknown column: {name}")


def auto_place(columns: Sequence[Column]) -> int | None:
    return next((k for k, c in enumerate(columns) if c.auto_increment), None)


def without_auto(columns: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(replace(c, auto_increment=False) for c in columns)


class Store(ABC):
    """Tables and views by name.  Rows are lists of texts, None for NULL."""

    @abstractmethod
    def has_table(self, table: Relation) -> bool: ...

    @abstractmethod
    def has_view(self, view: Relation) -> bool: ...

    @abstractmethod
    def read(self, table: Relation) -> Table: ...

    @abstractmethod
    def describe(self, table: Relation) -> tuple[Column, ...]: ...

    @abstractmethod
    def save(self, table: Relation, columns: Sequence[Column], df: DataFrame | None) -> None:
        """Write the table anew: ``df`` as in ``Table``, or no rows."""

    @abstractmethod
    def change(self, table: Relation, columns: Sequence[Column], df: DataFrame, drop_hits: bool) -> int:
        """Write the table anew from ``df``, which has ``HIT`` beside a table's columns, and count its hits in the same pass.

        Without hits the table stays as it is; ``drop_hits`` leaves them out.
        """

    @abstractmethod
    def append(self, table: Relation, row: list[str | None]) -> None: ...

    @abstractmethod
    def next_number(self, table: Relation) -> int:
        """The next number of the table's AUTO_INCREMENT column."""

    @abstractmethod
    def drop(self, table: Relation) -> None: ...

    @abstractmethod
    def view_text(self, view: Relation) -> str: ...

    @abstractmethod
    def put_view(self, view: Relation, text: str) -> None: ...

    @abstractmethod
    def drop_view(self, view: Relation) -> None: ...

    def default_alias(self, table: Relation) -> str:
        return table.name
