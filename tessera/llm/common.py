"""What the operators share: tables, scratch space and portable text rules."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this subpackage travel to executors whole, so those need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Bytes that separate words wherever a contract speaks of ``[^\x20\x09-\x0D]+``.
WORD_BREAKS = " \t\n\x0b\x0c\r"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share, under one folder of this application.

    The shared folder is the session's ``spark.checkpoint.dir``; only where that
    is unset (tests, local runs) a local folder is chosen.  What is left in the
    application's folder goes when the driver ends.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
        root = sc.getCheckpointDir()
    own = f"{root.rstrip('/')}/tessera-{sc.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove_at_exit, sc, own)
    return f"{own}/{uuid.uuid4().hex}"


_OWN: set[str] = set()


def _remove(sc, path: str) -> None:
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(sc, path: str) -> None:
    if sc._jsc is not None:  # still running
        _remove(sc, path)


#: Small rows of a scratch file; a file also costs its folder, its checksum and their permissions.
FILE_ROWS = 500_000


def files_for(rows: int) -> int:
    """How many files so many small rows are written to."""
    return max(8, -(-rows // FILE_ROWS))


def materialize(df: DataFrame, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it.

    Unlike a local checkpoint the rows survive the loss of any executor.  Where
    ``rows``, about the number of small rows that the last step works on, is
    given, they are written by as few tasks as have ``FILE_ROWS`` each; ``dealt``
    moves them there first, for rows that many tasks make at some cost.
    """
    path = scratch_dir(df.sparkSession)
    if rows is not None:
        df = df.repartition(files_for(rows)) if dealt else df.coalesce(files_for(rows))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the scratch files behind frames of ``materialize`` that no later plan reads."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/tessera-{sc.applicationId}/" in folder:
                _remove(sc, folder)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Bytes and rows that a task turns into Python values at once.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 1000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``PIECE_BYTES``, a single row at least: a batch of long texts need not become Python at once."""
    for batch in batches:
        n = min(PIECE_ROWS, max(1, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` over ``pieces``; Spark itself bounds the bytes of the batches that it sends."""
    return df.mapInArrow(lambda batches: run(pieces(batches)), schema)


#: A key with more than one in so many of all rows is joined by broadcast; there are fewer such keys than this.
SHARE = 10_000


def split_join(rows: DataFrame, table: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, one row a key, whose column ``size`` has how many of all ``total`` rows the key has.

    Keys that hold over one in ``SHARE`` of the rows go out in a broadcast that
    this bounds, so no task gets all rows of a hot key; the others meet by shuffle.
    """
    hot = F.col(size) * SHARE > total
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(table.where(~hot), on))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes of ``text`` with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def words(text: str) -> list[bytes]:
    """Lower-cased words between spaces, tabs, line and page breaks."""
    return ascii_lower(text).split()


_BREAK = re.compile(f"[{WORD_BREAKS}]")
#: Characters of a text that are words in memory at once; a text of fewer is one list.
LIST_CHARS = 1 << 20


def word_lists(text: str, lower: bool = True) -> Iterator[list[bytes]]:
    """The words of a whole text, list after list, so that a very long one is never all objects at once."""
    at = 0
    while at < len(text):
        end = at + LIST_CHARS
        if end < len(text):
            found = _BREAK.search(text, end)
            end = found.start() if found else len(text)
        yield words(text[at:end]) if lower else text[at:end].encode("utf-8", "surrogatepass").split()
        at = end


def shingled(text: str, width: int, lower: bool = True) -> Iterator[list[bytes]]:
    """The space-joined shingles of a text's words, list after list; fewer words than ``width`` are one shingle."""
    last: list[bytes] = []
    some = False
    for w in word_lists(text, lower):
        w = last + w
        if len(w) >= width:
            some = True
            yield list(map(b" ".join, zip(*(w[i:] for i in range(width)))))
        last = w[max(0, len(w) - width + 1) :]
    if last and not some:
        yield [b" ".join(last)]


def sql_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(col: Column, n: int) -> Column:
    """CRC-32 of the column's text, modulo ``n``."""
    return F.crc32(col.cast("string").cast("binary")) % n
