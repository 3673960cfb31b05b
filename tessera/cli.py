"""Command line: a statement as arguments or on standard input, tables in the working folder.

``python -m tessera SELECT title FROM tasks`` runs a statement.  The entry
points ``tselect tinsert tupdate tdelete tcreate tdrop talter`` put their
keyword in front.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tessera.console import write_result
from tessera.errors import SqlError
from tessera.session import Session
from tessera.sources.files import FileStore

HELP = {
    "select": "SELECT [DISTINCT] *|expr [AS name], ... FROM source [alias], ... [WHERE expr] [GROUP BY column, ...] [HAVING expr]\n       [ORDER BY expr [ASC|DESC], ...] [LIMIT n] [OFFSET n]",
    "insert": "INSERT INTO table [(column, ...)] VALUES (expr, ...)",
    "update": "UPDATE table SET column = expr, ... [WHERE expr]",
    "delete": "DELETE FROM table [WHERE expr]",
    "create": "CREATE TABLE table (column [AUTO_INCREMENT] [= default], ...)\nCREATE VIEW view AS SELECT ...",
    "drop": "DROP TABLE table\nDROP VIEW view",
    "alter": "ALTER TABLE table ADD COLUMN column [AUTO_INCREMENT] [= default]\nALTER TABLE table DROP COLUMN column\nALTER TABLE table RENAME COLUMN column TO name\n"
    "ALTER TABLE table ALTER COLUMN column SET|DROP DEFAULT [expr]\nALTER TABLE table ALTER COLUMN column SET|DROP AUTO_INCREMENT\nALTER VIEW view AS SELECT ...",
}


def usage(command: str = "") -> str:
    return HELP.get(command) or "Statements:\n\n" + "\n\n".join(HELP.values())


def spark_session() -> SparkSession:
    cores = os.environ.get("TESSERA_CPUS", "*")
    return SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(args: Sequence[str] | None = None, keyword: str = "", spark: SparkSession | None = None, folder: str | None = None) -> int:
    """Run one statement over the tables of ``folder``, by default the working one; the exit code."""
    args = list(sys.argv[1:] if args is None else args)
    if args[:1] in (["--help"], ["-h"], ["help"]):
        print(usage((args[1:2] or [keyword])[0].lower()))
        return 0
    text = " ".join(args) if args else "" if sys.stdin.isatty() else sys.stdin.read()
    text = f"{keyword} {text}".strip()
    if not text or text.upper() == keyword.upper():
        print(usage(keyword.lower()))
        return 0
    spark = spark or spark_session()
    spark.sparkContext.setLogLevel("OFF")
    try:
        result = Session(spark, FileStore(spark, folder or os.getcwd())).sql(text)
        if result.success:
            write_result(sys.stdout, result)
            return 0
        print(result.error, file=sys.stderr)
    except SqlError as e:
        print(e, file=sys.stderr)
    return 1


def _command(keyword: str):
    return lambda: sys.exit(main(keyword=keyword))


tselect, tinsert, tupdate, tdelete, tcreate, tdrop, talter = map(_command, ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"))
