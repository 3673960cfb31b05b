"""Lineage cut through the folder that executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again; it outlives executors and the files it came from."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{(root or os.path.join(tempfile.gettempdir(), 'tessera-tables')).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame of ``rewritten``."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
