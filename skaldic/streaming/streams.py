"""The same operators on streams: restoring is a stateless join, counting unknown tokens keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diacritics import TOKEN, look_up


def texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string, at timestamp") -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def looked_up(stream: DataFrame, index: DataFrame) -> DataFrame:
    """Each token of the stream with what the static index says."""
    tokens = stream.select("doc_id", "at", F.explode(F.regexp_extract_all("text", F.lit(TOKEN))).alias("word"))
    return look_up(tokens, index)


def unknown_counts(stream: DataFrame, index: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Unknown tokens counted in windows of event time; rows later than the watermark no longer count."""
    found = looked_up(stream.withWatermark("at", late), index).where("is_unknown")
    return found.groupBy(F.window("at", window), "key").agg(F.count(F.lit(1)).alias("n"))
