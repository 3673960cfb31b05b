"""SimHash near-duplicates, linked through a segment-popcount embedding.

A 64-bit fingerprint maps to 32 coordinates, the bit counts of its two-bit
segments.  The Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints.  Written in unary the counts fit one long again
(each segment's bits sorted), and the Manhattan distance is the bit count of
an XOR, so the whole embedding costs four bitwise operations inside the JVM.

The grid: coordinates fall into ``g`` groups.  A distance of at most two
leaves at least ``g - 2`` groups equal, so two linked fingerprints meet in a
cell of one of the ``g * (g - 1) / 2`` choices of groups.  Cells compare their
members by Manhattan distance, then exactly.  A crowded cell compares no
pairs: each of its members is sent to its 65 neighbours at distance 0 or 1,
and those that meet are within distance two of each other; that is exact and
linear, however many members a cell has.

Only distinct fingerprints are compared, so a group of copies is one row.

Nulls and ties: a null or wordless text has fingerprint zero and links like
any other; a row with a null id belongs to its component and never names it.
Repeated rows are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, fresh, in_arrow, materialize, shingled, split_join, table
from tessera.llm.components import components
from tessera.llm.nearcopies import LEAST, WIDTH, near_copies

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Members of a cell that are compared pair by pair; a fuller cell goes by neighbours.
CROWDED = 24
_PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a whole text."""
    digest, ones, total = xxhash.xxh64_digest, np.zeros(64, np.int64), 0
    for rows in shingled(text or "", SHINGLE):
        for at in range(0, len(rows), _PIECE):
            raw = np.frombuffer(b"".join([digest(s, SEED) for s in rows[at : at + _PIECE]]), np.uint8).reshape(-1, 8)
            ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        total += len(rows)
    return int(np.packbits(2 * ones > total).view(">i8")[0]) if total else 0


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """``(doc_id, fp)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", into])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), text), run, f"doc_id long, {into} long")


def embedding(fp: Column) -> Column:
    """The 32 segment counts in unary, two bits each."""
    low, shifted = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(shifted).bitwiseAND(low), fp.bitwiseAND(shifted).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(groups: int) -> list[int]:
    """For each choice of all groups but two, the bits of its coordinates."""
    bits = [sum(3 << 2 * k for k in range(32) if k * groups // 32 == g) for g in range(groups)]
    return [_signed(sum(c)) for c in combinations(bits, groups - RADIUS)]


def groups_for(n: int) -> int:
    """More groups as fingerprints multiply, so that a cell stays near one unrelated member; every choice finds all links."""
    return next((g for g, most in ((5, 2e7), (6, 2e8), (7, 2e9)) if n <= most), 8)


def _near(pairs: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` that pass the Manhattan bound and then the exact distance."""
    bound = pairs.where(F.bit_count(embedding(F.col("u")).bitwiseXOR(embedding(F.col("v")))) <= RADIUS)
    return bound.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def links(prints: DataFrame, crowded: int = CROWDED, groups: int | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints that join all that are linked.

    ``prints(fp)`` are distinct.  Edges of a crowded cell lead to the smallest
    member at a shared neighbour rather than to every partner.  ``held`` gets
    the scratch tables that the edges are read from.
    """
    n = prints.count()
    groups = groups or groups_for(n)
    n_keyed = n * len(masks(groups))
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), embedding(F.col("fp")).bitwiseAND(F.lit(x)).alias("k")) for i, x in enumerate(masks(groups))]))
    keyed = prints.select("fp", cell.alias("c")).select("c.m", "c.k", "fp")
    # A cell of two needs no join: its smallest and largest members are the pair.
    cells = keyed.groupBy("m", "k").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    cells = materialize(cells, n_keyed)
    twos = _near(cells.where("n = 2").select("u", "v"))
    crowds = cells.where("n > 2").select("m", "k", "n")
    many = materialize(split_join(keyed, crowds, ["m", "k"], "n", n_keyed), n_keyed)
    if held is not None:
        held += [cells, many]
    few = many.where(F.col("n") <= crowded)
    pairs = few.select("m", "k", F.col("fp").alias("u")).join(few.select("m", "k", F.col("fp").alias("v")), ["m", "k"]).where("u < v")
    full = many.where(F.col("n") > crowded).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    there = full.select("fp", F.explode(flips).alias("at"))
    meet = there.groupBy("at").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    starred = there.join(meet.select("at", "u"), "at").where("u <> fp").select("u", F.col("fp").alias("v"))
    return twos.union(_near(pairs.select("u", "v"))).union(_near(starred)).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id, n_copies)`` of every row."""
    n = docs.count()
    prints = materialize(fingerprints(docs, text), n, dealt=True)
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), n)
    held: list[DataFrame] = []
    roots = components(links(distinct.select("fp"), held=held))
    discard(*held)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    found = materialize(split_join(named, ids, ["root"], "n", distinct.count()).select("fp", "component_id", "n_copies"), n)
    return split_join(prints, found, ["fp"], "n_copies", n).select("doc_id", "fp", "component_id", "n_copies")


def keep_one(docs: DataFrame, text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of its smallest id.

    Near copies have ``width``-word shingles of a Jaccard index of ``least`` or
    more, directly or through others.  Of rows of a group that repeat that id the
    one of the smallest text stays.  Rows with a null id are chosen among
    themselves: of each group one of them stays too.
    """
    key = fresh(docs, "__text_key")
    keyed = docs.withColumn(key, F.xxhash64(text))
    rows = materialize(near_copies(keyed, text, key, width, least))
    least_ids = rows.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
    first = split_join(rows, least_ids, ["root"], "n_rows", rows.count()).where("doc_id IS NULL OR doc_id = least")
    groups = first.groupBy("root", "doc_id").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    groups = materialize(groups)

    def of(chosen: DataFrame, *more: str) -> DataFrame:
        """Rows of ``docs`` with these ids and texts.  Both grow with the corpus, so they are merged, not broadcast, at every size."""
        x, y = keyed.alias("x"), chosen.hint("merge").alias("y")
        same = (F.col(f"x.{key}") == F.col("y.key")) & F.col("x.doc_id").cast("long").eqNullSafe(F.col("y.doc_id"))
        return x.join(y, same, "inner").select(*[F.col(f"x.`{c}`") for c in docs.columns], *[F.col(f"y.{c}").alias(f"{key}_{c}") for c in more])

    kept = of(groups.where("n = 1").select("doc_id", "key"))
    if groups.where("n > 1").limit(1).count():
        again = groups.where("n > 1").select("root", F.col("doc_id").alias("id"))
        same = (rows["root"] == again["root"]) & rows["doc_id"].eqNullSafe(again["id"])
        repeated = rows.join(again, same, "left_semi").distinct()
        rest = of(repeated, "root").groupBy(f"{key}_root", "doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce(text, F.lit(""))).alias("row"))
        kept = kept.unionByName(rest.select("row.*"))
    return kept


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")
