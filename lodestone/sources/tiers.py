"""Which files or parts to merge: those of one tier of size, once there are enough of them.

Tier 0 is everything up to ``floor``, and each next tier is ``factor`` times as wide. A group of ``factor`` members of a tier is merged into one, which
lies in a higher tier (or ends in tier 0 as long as it is below the floor). So each row is rewritten about once a tier, and after any number of appends
there are fewer than ``factor`` members in each of the logarithmically many tiers. What has reached ``ceiling`` is left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiers:
    factor: int = 8
    floor: int = 1 << 20
    ceiling: int = 1 << 30

    def __post_init__(self) -> None:
        if self.factor < 2 or not 0 < self.floor <= self.ceiling:
            raise ValueError("tiers need a factor of two or more, and a floor from one to the ceiling")

    def of(self, size: Column) -> Column:
        """The tier of a size; null is as good as nothing."""
        size = F.greatest(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(float(self.floor)))
        return F.ceil(F.log(size / self.floor) / F.log(F.lit(float(self.factor))) - 1e-9).cast("int")

    def due(self, files: DataFrame, within: list[str], at_once: int = 10_000) -> DataFrame:
        """``path, within.., chunk`` of the files to merge now: full groups of ``factor`` of a tier, of files equal in ``within``.

        Small tiers and old members first; about ``at_once`` files at most, the others are for the next time.
        """
        tiered = files.filter(F.coalesce("size", F.lit(0)) < self.ceiling).withColumn("_tier", self.of(F.col("size")))
        key = [*within, "_tier"]
        placed = tiered.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("version", "path")) - 1)
        groups = placed.withColumn("_g", F.floor(F.col("_r") / self.factor)).groupBy(*key, "_g").agg(F.collect_list("path").alias("paths"))  # factor paths at most
        full = groups.filter(F.size("paths") == self.factor).orderBy("_tier", "_g", *within).limit(max(1, at_once // self.factor))
        return full.withColumn("chunk", F.monotonically_increasing_id()).select(F.explode("paths").alias("path"), *within, "chunk")
