"""Text formats: one row a line, every value text.

A format reads its header on the driver and its rows through Spark, and writes
lines; ``register`` adds formats by file extension.  A NULL is written as the
store's null text, so that it differs from the empty text in every format.
"""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SqlError

_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#10;"), ("\r", "&#13;"))
_READ = 1 << 20


class Format(ABC):
    #: What stands between rows besides the line break.
    between = ""
    #: Where the header is over.
    body = "\n"

    @abstractmethod
    def header(self, text: str) -> list[str]:
        """Column names from the start of a file."""

    @abstractmethod
    def rows(self, spark: SparkSession, path: str, width: int) -> DataFrame:
        """``(row array<string>)`` of a file, in its order."""

    @abstractmethod
    def opening(self, names: list[str]) -> str: ...

    @abstractmethod
    def line(self, values: Column) -> Column:
        """A row as one line, from an array of texts without nulls."""

    @abstractmethod
    def closing(self, names: list[str]) -> str: ...


def _checked(row: Column, width: int, is_row: Column | None = None) -> Column:
    """The row if it has its width.  Lines that are no row pass: Spark may look at them before it filters."""
    bad = F.raise_error(F.lit("Row column count mismatch")).cast("array<string>")
    fits = F.when(F.size(row) == width, row).otherwise(bad)
    return fits if is_row is None else F.when(is_row, fits)


class Csv(Format):
    def header(self, text: str) -> list[str]:
        return _split_csv(text.split("\n", 1)[0])

    def rows(self, spark: SparkSession, path: str, width: int) -> DataFrame:
        """Quotes may open and close anywhere in a field; a comma after an even number of quotes parts fields."""
        line = F.col("value")
        lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where((F.col("at") > 0) & (line != ""))
        unquoted = lambda x: F.replace(F.regexp_replace(x, '"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"'))
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        parted = F.transform(F.split(line, ',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)', -1), unquoted)
        bad = F.raise_error(F.lit("Unterminated quoted CSV field")).cast("array<string>")
        fields = F.when(~line.contains('"'), F.split(line, ",", -1)).when(quotes % 2 == 0, parted).otherwise(bad)
        return lines.select(_checked(fields, width, (F.col("at") > 0) & (line != "")).alias("row"))

    def opening(self, names: list[str]) -> str:
        return ",".join(_quoted_csv(n) for n in names) + "\n"

    def line(self, values: Column) -> Column:
        quoted = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        # A lone empty value needs its quotes, or the line would be blank and skipped.
        one = lambda v: F.when(v.rlike("[\n\r]"), F.raise_error(F.lit("CSV tables cannot hold line breaks")).cast("string")).when(v.rlike('[,"]') | (v == ""), quoted(v)).otherwise(v)
        return F.array_join(F.transform(values, one), ",")

    def closing(self, names: list[str]) -> str:
        return ""


def _quoted_csv(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if re.search('[,"\n\r]', text) else text


def _split_csv(line: str) -> list[str]:
    """Fields of a line; quotes may open and close anywhere in a field."""
    out, field, inside, at = [], "", False, 0
    line = line.rstrip("\r")
    while at < len(line):
        c = line[at]
        if c == '"' and inside and line[at + 1 : at + 2] == '"':
            field, at = field + '"', at + 1
        elif c == '"':
            inside = not inside
        elif c == "," and not inside:
            out.append(field)
            field = ""
        else:
            field += c
        at += 1
    if inside:
        raise SqlError("Unterminated quoted CSV field")
    return [*out, field]


class _Lines(Format):
    """Formats whose rows are lines with an array of strings."""

    row_start = r"^\s*\["

    def rows(self, spark: SparkSession, path: str, width: int) -> DataFrame:
        is_row = F.col("value").rlike(self.row_start)
        lines = spark.read.text(path).where(is_row)
        body = F.regexp_extract("value", r"(\[.*\])\s*,?\s*$", 1)
        return lines.select(_checked(F.from_json(body, "array<string>"), width, is_row).alias("row"))

    def line(self, values: Column) -> Column:
        return F.concat(F.lit(self.indent), F.to_json(values))

    indent = "  "


class Json(_Lines):
    between = ","
    indent = "    "
    body = r'(?s)"columns".*"rows"\s*:\s*\[\s*\S|"rows".*"columns"\s*:\s*\[.*\]'

    def header(self, text: str) -> list[str]:
        m = re.search(r'"columns"\s*:\s*', text)
        if not m:
            raise SqlError("JSON table has no columns")
        return json.JSONDecoder().raw_decode(text, m.end())[0]

    def rows(self, spark: SparkSession, path: str, width: int) -> DataFrame:
        by_line = super().rows(spark, path, width)
        if re.search(r'"rows"\s*:\s*\[[ \t\r]*(\n|\Z|\]\s*\})', _start(path, self)):
            return by_line
        whole = spark.read.schema("columns array<string>, rows array<array<string>>").json(path, multiLine=True)
        return whole.select(F.explode("rows").alias("row")).select(_checked(F.col("row"), width).alias("row"))

    def opening(self, names: list[str]) -> str:
        return '{\n  "columns": ' + json.dumps(names, ensure_ascii=False) + ',\n  "rows": [\n'

    def closing(self, names: list[str]) -> str:
        return "  ]\n}\n"


class Toml(_Lines):
    between = ","
    body = r"(?m)^\s*rows\s*="

    def header(self, text: str) -> list[str]:
        m = re.search(r"(?m)^\s*columns\s*=\s*(?=\[)", text)
        if not m:
            raise SqlError("TOML table has no columns")
        return json.JSONDecoder().raw_decode(text, m.end())[0]

    def opening(self, names: list[str]) -> str:
        return "columns = " + json.dumps(names, ensure_ascii=False) + "\nrows = [\n"

    def closing(self, names: list[str]) -> str:
        return "]\n"


class Yaml(_Lines):
    row_start = r"^\s*- \["
    indent = "  - "
    body = "(?m)^rows:"

    def header(self, text: str) -> list[str]:
        m = re.search(r"(?m)^columns:[ \t]*\n((?:[ \t]*-[ \t]*\".*\"[ \t]*\n?)*)", text)
        if not m:
            raise SqlError("YAML table has no columns")
        return [json.loads(x) for x in re.findall(r"(?m)^[ \t]*-[ \t]*(\".*\")[ \t]*$", m[1])]

    def opening(self, names: list[str]) -> str:
        return "columns:\n" + "".join(f"  - {json.dumps(n, ensure_ascii=False)}\n" for n in names) + "rows:\n"

    def closing(self, names: list[str]) -> str:
        return ""


class Xml(Format):
    body = "<rows"

    def header(self, text: str) -> list[str]:
        m = re.search(r"(?s)<columns>(.*?)</columns>", text)
        if not m:
            raise SqlError("XML table has no columns")
        return [_unescaped(x) for x in re.findall(r"<column>(.*?)</column>", m[1])]

    def rows(self, spark: SparkSession, path: str, width: int) -> DataFrame:
        def plain(v: Column) -> Column:
            for raw, safe in reversed(_ENTITIES):
                v = F.replace(v, F.lit(safe), F.lit(raw))
            return v

        is_row = F.col("value").contains("<row>")
        lines = spark.read.text(path).where(is_row)
        values = F.regexp_extract_all("value", F.lit("<value>(.*?)</value>"), F.lit(1))
        return lines.select(F.transform(_checked(values, width, is_row), plain).alias("row"))

    def line(self, values: Column) -> Column:
        def safe(v: Column) -> Column:
            for raw, entity in _ENTITIES:
                v = F.replace(v, F.lit(raw), F.lit(entity))
            return F.concat(F.lit("<value>"), v, F.lit("</value>"))

        return F.concat(F.lit("    <row>"), F.array_join(F.transform(values, safe), ""), F.lit("</row>"))

    def opening(self, names: list[str]) -> str:
        return "<table>\n  <columns>\n" + "".join(f"    <column>{_escaped(n)}</column>\n" for n in names) + "  </columns>\n  <rows>\n"

    def closing(self, names: list[str]) -> str:
        return "  </rows>\n</table>\n"


def _escaped(text: str) -> str:
    for raw, safe in _ENTITIES:
        text = text.replace(raw, safe)
    return text


def _unescaped(text: str) -> str:
    for raw, safe in reversed(_ENTITIES):
        text = text.replace(safe, raw)
    return text


FORMATS: dict[str, Callable[[], Format]] = {}


def register(extension: str, make: Callable[[], Format]) -> None:
    """Add a format; an extension has one format."""
    if extension in FORMATS:
        raise SqlError(f"Format already registered: {extension}")
    FORMATS[extension] = make


for _extension, _make in (("csv", Csv), ("json", Json), ("toml", Toml), ("yaml", Yaml), ("yml", Yaml), ("xml", Xml)):
    register(_extension, _make)


def _start(path: str, kind: Format) -> str:
    """The file from its start to where its rows begin, however far that is."""
    with open(path, encoding="utf-8", newline="") as f:
        text = ""
        while more := f.read(_READ):
            text += more
            if re.search(kind.body, text):
                break
        return text


def read_header(path: str, kind: Format) -> list[str]:
    return kind.header(_start(path, kind))
