"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets into contiguous shards.

Only a narrow row of each document (id, size, checksum) is moved, never its text. The rows are range-partitioned
by id; the totals of the partitions, one row each, give every partition its offset, and a running sum inside
each partition does the rest. No task holds more than one range, and no group of equal texts or of one source matters.

Defined results: a null text has no bytes, so size 1 and checksum 0; null ids come first; repeated rows and ties
are told apart by size and checksum, and rows equal in all three are interchangeable; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text, plus 1 for the document's end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``: shards 0..n-1 of nearly equal bytes, contiguous in id order, slots gapless from 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        byte_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = materialise(rows, "shard-rows")  # the range partitioner samples: let it sample these, not the texts
    order = ["_id", "size", "text_crc32"]
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(1024))  # lets a run of equal rows be cut between partitions
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie")
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), "shard-ranges")

    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), zero).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), zero).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_total"),
    )  # one row per partition of the range shuffle: bounded by the number of its partitions
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    at = ranged.join(F.broadcast(offsets), "_part").select(
        *order,
        (F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_start"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_row"),
        "_total",
    )
    middle = 2 * F.col("_start").cast("decimal(38,0)") + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (2 * F.col("_total"))).cast("int"))
    placed = materialise(at.withColumn("shard", shard).select(*order, "shard", "_row"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot")
    )
