"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay a distributed table ``(a, b)`` with ``a > b``, written after each round; only a count and a checksum, which the write itself
takes, come to the driver. The large step joins each edge to the least neighbour of its lower end, an aggregation that combines before
its shuffle, so the centre of a large star is no group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.inline(F.array(F.struct(F.col("a").alias("b"), F.col("b").alias("low")), F.struct(F.col("b"), F.col("b").alias("low"))))
    least = edges.select(ends).groupBy("b").agg(F.min("low").alias("m"))
    return edges.join(least, "b").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    both = F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return low.select(both).filter("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and checksum."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    out = materialise(marked, "edges")
    return out, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; the root is the component's smallest node. Loops and repeats do no harm; edges with a null are dropped."""
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _written(down)
    while mark[0]:  # each round brings a node nearer to its root; at the end the stars reproduce themselves
        before, old = mark, now
        now, mark = _written(_small_star(_large_star(now)))
        discard(old)
        if mark == before:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.scratch = now.scratch  # who has written the result may discard it
    return out
