"""Rows pulled one at a time, in order, without collecting a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SqlError, reason
from tessera.functions.values import number_text

NULL_TEXT = "NULL"


def _shown(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return number_text(col.cast("double"))
    if isinstance(kind, T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


@dataclass(frozen=True)
class RowStream:
    """The rows of a result as texts.  It can be opened again: each pass runs the plan anew."""

    df: DataFrame
    prefetch: bool = True

    @property
    def names(self) -> list[str]:
        return self.df.columns

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        plain = self.df.toDF(*[f"c{k}" for k in range(len(self.df.columns))])
        texts = plain.select(*[F.coalesce(_shown(F.col(f.name), f.dataType), F.lit(NULL_TEXT)).alias(f.name) for f in plain.schema])
        try:
            yield from map(tuple, texts.toLocalIterator(prefetchPartitions=self.prefetch))
        except (PySparkException, Py4JError) as e:
            raise SqlError(reason(e)) from e


def drive(rows: Iterator, consumer: Callable[[object], bool]) -> int:
    """Feed rows to a consumer until it returns false; how many it got, the last one included."""
    n = 0
    for row in rows:
        n += 1
        if not consumer(row):
            break
    return n
