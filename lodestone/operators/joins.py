"""As-of and range joins as equi-joins and windows, so that Spark partitions them by key and no pair is made that does not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before its time (before, if ``strict``) for equal ``on``; nulls if there is none.

    Both tables go through one sort by key and time; of right rows of one time the greatest in ``columns`` counts. Rows without a key or time match nothing.
    """
    names = [f"_l{k}" for k in range(len(left.columns))]
    taken = F.struct(*[F.col(f"`{c}`") for c in columns])
    own = left.select(*[F.col(f"`{c}`") for c in on], F.col(f"`{left_time}`").alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, names, strict=True)]).alias("_row"))
    other = right.select(*[F.col(f"`{c}`") for c in on], F.col(f"`{right_time}`").alias("_at"), F.lit(1 if strict else 0).alias("_side"), taken.alias("_taken"))
    other = other.dropna(subset=[*on, "_at"])
    both = own.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy("_at", "_side", "_taken").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_taken", ignorenulls=True).over(order)).filter(F.col("_row").isNotNull())
    keyed = F.col("_at").isNotNull()
    for c in on:
        keyed = keyed & F.col(f"`{c}`").isNotNull()
    return found.select(*[F.col("_row")[n].alias(c) for c, n in zip(left.columns, names, strict=True)], *[F.when(keyed, F.col("_last")[c]).alias(c) for c in columns])


def range_join(left: DataFrame, right: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with ``low <= point <= high``: bins of ``width`` make it an equi-join. ``width`` should be near a range's usual length: a range stands in each bin that it touches."""
    bin_of = lambda c: F.floor(c.cast("double") / width)
    binned = right.withColumns({"_lo": low, "_hi": high}).filter("_lo <= _hi").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_lo")), bin_of(F.col("_hi")))))
    pointed = left.withColumn("_point", point).withColumn("_bin", bin_of(F.col("_point")))
    return pointed.join(binned, "_bin").filter("_point between _lo and _hi").drop("_bin", "_lo", "_hi", "_point")
