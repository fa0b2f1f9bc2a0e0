"""Helpers shared by the training-data operators: shared storage, digests of words, small tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts state words: runs of anything else.
SPACES = r"[\x20\x09-\x0D]+"
#: The same characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.skaldic.test.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.TemporaryDirectory(prefix="skaldic-")
        atexit.register(own.cleanup)
        where = f"file://{own.name}"
        spark.conf.set("spark.skaldic.test.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later stages restart from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys (8 bytes each) that may be broadcast: 64 MB at most on the driver and in each executor.
BROADCAST_KEYS = 4_000_000


def bounded(keys: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table of one long per row, marked for broadcast if a count proves it small; else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= (BROADCAST_KEYS if most is None else most) else keys


def words_of(text: Column) -> Column:
    """Array of the words of a text: runs without ASCII white space; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def words_fast(text: Column) -> Column:
    """words_of without a lambda: the text is trimmed first, so that split has no empty ends."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def shifted(words: Column, n: int) -> list[Column]:
    """The n columns words[i], words[i + 1], ... as arrays of the length of words (short at the end)."""
    return [words if k == 0 else F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))) for k in range(n)]


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds; null doc_id: 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
