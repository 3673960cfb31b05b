"""A folder of tables: text files, Parquet, and views.

A table's name finds ``<name>.<extension>`` of any registered format.  New
tables get the store's default format unless their path says otherwise.

An insert appends one line to a journal beside the file, so it starts no job;
a scan reads the file and then the journal.  Any other change writes a new
file next to the old one and swaps it in, so a crash leaves one of the two
whole, and then drops the journal.  Executors write the new file's lines; the
driver joins their parts, so the folder must be one that they share.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SqlError
from tessera.functions.values import number_of
from tessera.plans.nodes import Relation
from tessera.sources.base import HIT, ORDER, Column, Store, Table, auto_place
from tessera.sources.formats import FORMATS, Format, read_header
from tessera.sources.scratch import discard, rewritten

_JOURNAL, _COUNTER, _VIEW = ".append", ".autoincrement", ".view.sql"
#: Rows of the journal come after every row of the file.
_AFTER = 1 << 62


class FileStore(Store):
    def __init__(self, spark: SparkSession, root: str = ".", default: str = "csv", null_text: str = "__NULL__"):
        self.spark, self.root, self.default, self.null_text = spark, os.path.abspath(root), default, null_text

    # Paths.

    def _candidates(self, base: str) -> list[str]:
        return [p for ext in [*FORMATS, "parquet"] if os.path.exists(p := f"{base}.{ext}")]

    def _base(self, table: Relation) -> str:
        return os.path.join(self.root, table.name)

    def _find(self, table: Relation) -> str | None:
        base = self._base(table)
        if table.is_path and base.rsplit(".", 1)[-1] in [*FORMATS, "parquet"]:
            return base if os.path.exists(base) else None
        found = self._candidates(base)
        if len(found) > 1:
            raise SqlError(f"Ambiguous table reference: {table.name}")
        return found[0] if found else None

    def _path(self, table: Relation) -> str:
        path = self._find(table)
        if path is None:
            raise SqlError(f"Table does not exist: {table.name}")
        return path

    def _format(self, path: str) -> Format:
        extension = path.rsplit(".", 1)[-1]
        if extension not in FORMATS:
            raise SqlError(f"Tables of this format are read-only: {path}")
        return FORMATS[extension]()

    def _view_path(self, view: Relation) -> str:
        base = self._base(view)
        return base if base.endswith(_VIEW) else base + _VIEW

    def default_alias(self, table: Relation) -> str:
        name = os.path.basename(table.name)
        return name.removesuffix(_VIEW) if name.endswith(_VIEW) else name.rsplit(".", 1)[0] if table.is_path else name

    # Tables.

    def has_table(self, table: Relation) -> bool:
        return self._find(table) is not None

    def describe(self, table: Relation) -> tuple[Column, ...]:
        path = self._path(table)
        if path.endswith(".parquet"):
            return tuple(Column(n) for n in self.spark.read.parquet(path).columns)
        return tuple(map(Column.parse, read_header(path, self._format(path))))

    def read(self, table: Relation) -> Table:
        path, columns = self._path(table), self.describe(table)
        names = [f"c{k}" for k in range(len(columns))]
        if path.endswith(".parquet"):
            return Table(columns, self.spark.read.parquet(path).toDF(*names), False, False)
        rows = self._format(path).rows(self.spark, path, len(columns)).withColumn(ORDER, F.monotonically_increasing_id())
        if os.path.exists(path + _JOURNAL):
            more = self.spark.read.text(path + _JOURNAL).select(F.from_json("value", "array<string>").alias("row"))
            rows = rows.unionAll(more.withColumn(ORDER, F.monotonically_increasing_id() + _AFTER))
        value = lambda k: F.when(F.col("row")[k] != self.null_text, F.col("row")[k])
        return Table(columns, rows.select(*[value(k).alias(n) for k, n in enumerate(names)], ORDER))

    def save(self, table: Relation, columns: Sequence[Column], df: DataFrame | None) -> None:
        path = self._find(table)
        if path is None:
            base = self._base(table)
            path = base if base.rsplit(".", 1)[-1] in FORMATS else f"{base}.{self.default}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self._swap(path, columns, df, False)

    def change(self, table: Relation, columns: Sequence[Column], df: DataFrame, drop_hits: bool) -> int:
        return self._swap(self._path(table), columns, df, drop_hits)

    def _swap(self, path: str, columns: Sequence[Column], df: DataFrame | None, drop_hits: bool) -> int:
        """Put a new file in the place of the old one, unless ``df`` has ``HIT`` and no hits; returns their number."""
        new, auto, kind, hits, most = path + ".new", auto_place(columns), self._format(path), 0, None
        lines = None if df is None else self._lines(kind, columns, df, drop_hits)
        kept = None
        if lines is not None and (HIT in df.columns or auto is not None):
            lines = kept = rewritten(lines)  # so that counting and writing run the plan once
            hits, most = lines.agg(F.count_if("hit"), F.max("n")).first()
        try:
            if df is not None and HIT in df.columns and not hits:
                return 0
            self._write(new, kind, [c.stored for c in columns], lines)
        except BaseException:
            if os.path.exists(new):
                os.remove(new)
            raise
        finally:
            if kept is not None:
                discard(kept)
        os.replace(new, path)
        for sidecar in (_JOURNAL, _COUNTER):
            if os.path.exists(path + sidecar):
                os.remove(path + sidecar)
        if auto is not None:
            self._count(path, (most or 0) + 1)
        return hits

    def _lines(self, kind: Format, columns: Sequence[Column], df: DataFrame, drop_hits: bool) -> DataFrame:
        """``(line, n, hit)`` and the order of the rows of a new file; rows that go have no line."""
        auto = auto_place(columns)
        values = F.array(*[F.coalesce(f"c{k}", F.lit(self.null_text)) for k in range(len(columns))])
        number = number_of(F.col(f"c{auto}")) if auto is not None else F.lit(None)
        hit = F.col(HIT) if HIT in df.columns else F.lit(False)
        gone = hit & F.lit(drop_hits)
        return df.select(F.when(~gone, kind.line(values)).alias("line"), F.when(~gone, number).cast("long").alias("n"), hit.alias("hit"), ORDER)

    def _write(self, path: str, kind: Format, names: list[str], lines: DataFrame | None) -> None:
        """Write a whole file.  Executors write its lines, in parts beside it; here the parts' bytes are put together."""
        parts, end = f"{path}.parts", f"{kind.between}\n".encode()
        try:
            with open(path, "wb") as f:
                f.write(kind.opening(names).encode())
                if lines is not None:
                    rows = lines.where("line IS NOT NULL").orderBy(ORDER)
                    rows.select(F.concat("line", F.lit(kind.between))).write.text(parts, lineSep="\n")
                    start = f.tell()
                    for name in sorted(x for x in os.listdir(parts) if x.startswith("part-")):
                        with open(os.path.join(parts, name), "rb") as part:
                            shutil.copyfileobj(part, f, 1 << 20)
                    if kind.between and f.tell() > start:
                        f.seek(-len(end), os.SEEK_CUR)
                        f.truncate()
                        f.write(b"\n")
                f.write(kind.closing(names).encode())
                f.flush()
                os.fsync(f.fileno())
        finally:
            shutil.rmtree(parts, ignore_errors=True)

    def _count(self, path: str, number: int) -> None:
        with open(path + _COUNTER, "w", encoding="utf-8") as f:
            f.write(str(number))

    def append(self, table: Relation, row: list[str | None]) -> None:
        path = self._path(table)
        columns = self.describe(table)
        self._format(path)
        auto = auto_place(columns)
        if auto is not None:
            try:
                number = int(float(row[auto] or ""))
            except ValueError:
                raise SqlError(f"AUTO_INCREMENT value is no number: {row[auto]}") from None
        with open(path + _JOURNAL, "a", encoding="utf-8") as f:
            f.write(json.dumps([self.null_text if v is None else v for v in row], ensure_ascii=False) + "\n")
        if auto is not None:
            self._count(path, number + 1)

    def next_number(self, table: Relation) -> int:
        path = self._path(table)
        if os.path.exists(path + _COUNTER):
            with open(path + _COUNTER, encoding="utf-8") as f:
                return int(f.read())
        found = self.read(table)
        most = found.df.agg(F.max(number_of(F.col(f"c{auto_place(found.columns)}")))).first()[0]
        return int(most or 0) + 1

    def drop(self, table: Relation) -> None:
        path = self._path(table)
        self._format(path)
        for p in (path, path + _JOURNAL, path + _COUNTER):
            if os.path.exists(p):
                os.remove(p)

    # Views.

    def has_view(self, view: Relation) -> bool:
        return os.path.exists(self._view_path(view))

    def view_text(self, view: Relation) -> str:
        if not self.has_view(view):
            raise SqlError(f"View does not exist: {view.name}")
        with open(self._view_path(view), encoding="utf-8") as f:
            return f.read()

    def put_view(self, view: Relation, text: str) -> None:
        path = self._view_path(view)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path + ".new", path)

    def drop_view(self, view: Relation) -> None:
        if not self.has_view(view):
            raise SqlError(f"View does not exist: {view.name}")
        os.remove(self._view_path(view))
