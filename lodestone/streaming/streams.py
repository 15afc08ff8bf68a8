"""Change streams of the file log, windowed aggregation with watermarks, and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import nodes as q
from ..plans.compile import Compiler
from ..sources.txlog import ACTION_SCHEMA


def log_changes(spark: SparkSession, table: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the log's adds and removes, each new version once."""
    raw = spark.readStream.schema(ACTION_SCHEMA).option("pathGlobFilter", "[0-9]*.json").option("maxFilesPerTrigger", files_per_trigger).json(f"{table.rstrip('/')}/_log")
    return raw.filter(F.col("action").isin("add", "remove"))


def matching_stream(df: DataFrame, query: q.Query, fields: q.Fields | None = None) -> DataFrame:
    """The rows of a stream that a query matches: a standing search."""
    return df.filter(Compiler(df.schema, fields).compile(query))


def windowed(df: DataFrame, time: str, duration: str, keys: list[str], aggs: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregation by event-time windows; rows later than ``late`` are dropped. Works on streams and on tables."""
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.window(time, duration, slide) if slide else F.window(time, duration), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.session_window(time, gap), *keys).agg(*aggs)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])
