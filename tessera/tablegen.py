"""A table of made-up people, for trying things out: ``(id AUTO_INCREMENT, name, city, country)``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cli import spark_session
from tessera.plans.nodes import Relation
from tessera.sources.base import ORDER, Column
from tessera.sources.files import FileStore

NAMES = "Ada Bela Chloe Dov Emil Farah Goro Hana Ines Jonas Kira Luca".split()
PLACES = [("Oslo", "Norway"), ("Porto", "Portugal"), ("Quito", "Ecuador"), ("Riga", "Latvia"), ("Suva", "Fiji"), ("Tunis", "Tunisia")]


def people(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows as a store saves them; the same rows for the same seed, by the digits of an MD5."""
    drawn = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), "id").cast("binary")), 1, 8), 16, 10).cast("long")
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), (drawn(salt) % len(options) + 1).cast("int"))
    place = lambda k: pick([p[k] for p in PLACES], 2)
    return spark.range(1, n + 1).select(F.col("id").cast("string").alias("c0"), pick(NAMES, 1).alias("c1"), place(0).alias("c2"), place(1).alias("c3"), F.col("id").alias(ORDER))


def main() -> None:
    spark = spark_session()
    columns = [Column("id", True), Column("name"), Column("city"), Column("country")]
    FileStore(spark).save(Relation("gen"), columns, people(spark, int(sys.argv[1]) if len(sys.argv) > 1 else 1000))


if __name__ == "__main__":
    main()
