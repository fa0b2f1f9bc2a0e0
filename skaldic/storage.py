"""Cut a long lineage by a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read again; a temporary folder only where that is unset and the master is local."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.skaldic.scratch", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.TemporaryDirectory(prefix="skaldic-")
        atexit.register(own.cleanup)
        where = f"file://{own.name}"
        spark.conf.set("spark.skaldic.scratch", where)
    path = f"{where.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(words: DataFrame) -> DataFrame:
    """Rows dealt out evenly before each becomes many: a small file is one task's scan, and its forms would all be made there."""
    return words.repartition(2 * words.sparkSession.sparkContext.defaultParallelism)
