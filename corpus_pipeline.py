"""The corpus pipeline: from raw documents to a training mix.

``run`` applies ``STAGES`` in order.  Each stage gets all that its predecessor
kept, written as Parquet to the folder that executors share and read again, so
a lost executor costs one stage at most and no plan grows past a stage.

All stages but the last return the columns of documents, further ones and such
as have names that operators use inside among them.  Empty documents give an
empty result at every stage, and repeated rows are treated alike but for
near-duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.mixing import mixed
from tessera.llm.quality import keep_good
from tessera.llm.secrets import mask_secrets
from tessera.llm.simhash import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resample rejects go.

    A null or empty text has weight zero, a null id its own noise; rows of equal keys stay or go together.
    Without labels of both kinds all stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 or more of their five-word shingles, that of the smallest id stays.

    Null and wordless texts are copies of each other.  Of rows that repeat the id, that of the smallest text stays;
    rows with a null id are chosen among themselves.
    """
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and short texts hold none.  Items with a null id count, those with a null text or under five words do not.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars``, if there, follows a changed text.  A null text stays null."""
    masked = mask_secrets(docs)
    changed = F.col("text").contains("<secret>")
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mix, with the times that each document is used.

    A null language or source is the empty one, a null text has no tokens; rows of equal ids in a leaf go together.
    Columns named ``domain``, ``n_tokens`` and ``epochs`` are replaced.
    """
    return mixed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: XXH64 fingerprints, components and string tiling have no DuckDB SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
