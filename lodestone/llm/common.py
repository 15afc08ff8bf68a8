"""What several training-data operators share: words, let-bindings, scratch tables and hot keys."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but the space and the controls 0x09-0x0D.
SEPARATORS = r"[ \t-\r]+"
_SCRATCH: set[str] = set()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and hand it to ``body``.

    An expression that a lambda merely captures is evaluated again for every element, which turns
    linear work into quadratic; a lambda's own variable is evaluated once.
    """
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that the result does not depend on a locale or on Unicode tables."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the input does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine if it is unset and all run here (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _context_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it cuts the lineage, and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` has written and that nothing reads any more."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _SCRATCH.discard(df.scratch)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def clear_scratch() -> None:
    """Delete what :func:`materialise` has written; call it when no result that reads it is needed any more."""
    spark = SparkSession.getActiveSession()
    if spark is None or not _SCRATCH:
        return
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in list(_SCRATCH):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _SCRATCH.discard(path)
    except Exception:  # the JVM may be gone already when the interpreter exits
        pass


#: A key of this share of the rows or more is hot; so there are at most as many hot keys as its inverse.
HOT_KEYS = 500


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` to ``table`` (unique in ``key``) that no hot key can bend.

    The few keys that many rows share are joined by broadcast, at most HOT_KEYS rows; all others by shuffle, where the rows of hot keys
    take part under keys of their own that match nothing.
    """
    total = rows.count()
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__k"))
    hot = counts.filter(F.col("__k") >= max(2, -(-total // HOT_KEYS))).select(F.col(key).alias("__hot"))
    names = [c for c in table.columns if c != key]
    hot_table = F.broadcast(table.join(F.broadcast(hot), table[key] == F.col("__hot"), "left_semi").select(F.col(key).alias("__hot"), F.struct(*names).alias("__h")))
    first = rows.join(hot_table, F.col(key) == F.col("__hot"), "left")
    spread = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    first = first.withColumn("__key", F.when(F.col(key).isNotNull() & F.col("__hot").isNull(), F.col(key).cast("string")).otherwise(spread))
    cold = table.select(F.col(key).cast("string").alias("__key"), F.struct(*names).alias("__c"))
    out = first.join(cold, "__key", "left").withColumn("__v", F.coalesce("__h", "__c"))
    return out.select(*rows.columns, *[F.col("__v")[c].alias(c) for c in names])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
