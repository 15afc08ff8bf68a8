"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``max_copies``, take those nearest to 1 in relative entropy under which each
source yields its target of tokens. The dual has one multiplier a source, and the rate of a document of size x is
``min(max_copies, exp(lambda_source * x / mean_size))``. Newton's method finds the multipliers; each iteration is one
distributed aggregation over the counts of (source, size), to which the documents are reduced before any shuffle. The rates
are rounded into whole copies by diffusing the error from the largest sizes to the smallest, so that each source
ends within about its smallest document of the target.

Defined results: null sources form one source, the last in order; a null or blank text has size 0, so it is never
repeated or counted; repeated rows are rows of their own; an empty table gives an empty one. Reruns agree: ties are
broken by a hash of the id and then the id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, words

#: Up to so many sources their sums and multipliers are lists on the driver and broadcast; more stay tables, and each source is solved where its sizes lie.
MAX_SOURCES = 100_000
_SALTS = 64


def targets_by_weight(sizes: list[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Share ``share * sum(sizes)`` by weight; no target passes ``cap`` times its size, and the excess is shared again by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _solve(hist: DataFrame, sources: list[dict], max_copies: float, tolerance: float, max_iterations: int) -> list[float]:
    """Newton's method, kept inside a bracket, on the dual of each source at once."""
    spark = hist.sparkSession
    lam = [0.0] * len(sources)
    low, high = [-math.inf] * len(sources), [math.inf] * len(sources)
    todo = {i for i, s in enumerate(sources) if s["size"] > 0 and s["target"] < max_copies * s["size"] * (1 - 1e-12)}
    for i, s in enumerate(sources):
        if i not in todo:
            lam[i] = math.inf if s["size"] > 0 else 0.0
    for _ in range(max_iterations):
        if not todo:
            break
        at = spark.createDataFrame([(i, lam[i], float(sources[i]["mean"])) for i in sorted(todo)], "_s int, _lam double, _mean double")
        z = F.col("size") / F.col("_mean")
        rate = F.exp(F.least(F.col("_lam") * z, F.lit(50.0)))
        tokens = F.col("_n") * F.col("size")
        sums = (
            hist.join(F.broadcast(at), "_s")  # at most MAX_SOURCES rows
            .groupBy("_s")
            .agg(
                F.sum(tokens * F.least(rate, F.lit(float(max_copies)))).alias("value"),
                F.sum(F.when(rate < max_copies, tokens * z * rate).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        for r in sums:
            i, gap = r["_s"], r["value"] - sources[r["_s"]]["target"]
            if abs(gap) <= tolerance * max(1.0, sources[i]["target"]):
                todo.discard(i)
                continue
            lam[i], low[i], high[i] = _step(lam[i], gap, r["slope"], low[i], high[i])
    return lam


def _numbered(sums: DataFrame) -> DataFrame:
    """Sources numbered in code-point order, null last."""
    order = [F.col("_source").isNull(), F.col("_source")]
    ranged = materialise(sums.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_k")).select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("_s", (F.col("_before") + place - 1).cast("int")).drop("_part", "_before")


def _table_of_targets(sums: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """What :func:`targets_by_weight` gives, for any number of sources: ``_s, _name, source_size, target, _mean``."""
    sources = materialise(_numbered(sums).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_s"), F.lit(len(weights))) + 1)), "mix-numbered")
    whole = sources.agg(F.sum("size").alias("size"), F.sum("_w").alias("w")).first()
    total, level = share * float(whole["size"] or 0), share * float(whole["size"] or 0) / (whole["w"] or 1.0)
    while True:  # the words for each unit of weight, from the sources that are not full at the last level; it only rises
        full = F.lit(level) * F.col("_w") > F.lit(float(cap)) * F.col("size")
        row = sources.agg(F.sum(F.when(full, F.col("size") * float(cap)).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w")).first()
        if not row["w"] or (total - row["full"]) / row["w"] <= level:
            break
        level = (total - row["full"]) / row["w"]
    target = F.least(F.lit(level) * F.col("_w"), F.lit(float(cap)) * F.col("size"))
    return sources.select("_s", F.col("_source").alias("_name"), F.col("size").alias("source_size"), target.alias("target"), F.greatest(F.lit(1.0), F.col("size") / F.col("n")).alias("_mean"))


def _solve_there(max_copies: float, tolerance: float, max_iterations: int):
    """The same iterations for one source, over its sizes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size, n = pdf["size"].to_numpy(float), pdf["_n"].to_numpy(float)
        target, z = float(pdf["target"].iloc[0]), size / float(pdf["_mean"].iloc[0])
        whole, lam, low, high = float((size * n).sum()), 0.0, -math.inf, math.inf
        if target >= max_copies * whole * (1 - 1e-12):
            lam = math.inf if whole > 0 else 0.0
        else:
            for _ in range(max_iterations):
                rate = np.exp(np.minimum(lam * z, 50.0))
                gap = float((n * size * np.minimum(rate, max_copies)).sum()) - target
                if abs(gap) <= tolerance * max(1.0, target):
                    break
                slope = float((n * size * z * rate)[rate < max_copies].sum())
                lam, low, high = _step(lam, gap, slope, low, high)
        return pd.DataFrame({"_s": pdf["_s"].iloc[:1], "_lam": [min(lam, 1e300)]})

    return run


def _step(lam: float, gap: float, slope: float, low: float, high: float) -> tuple[float, float, float]:
    """Newton's step, kept inside the bracket, which it narrows."""
    low, high = (lam, high) if gap < 0 else (low, lam)
    step = lam - gap / slope if slope > 0 else math.nan
    step = min(max(step, lam - 4.0), lam + 4.0) if step == step else step
    if not low < step < high:
        step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else lam + math.copysign(2.0, -gap)
    return step, low, high


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each size of one source; what a size takes too much or too little is passed on to the next smaller one."""
    pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
    out, carry = [], 0.0
    for size, n, rate, most in zip(pdf["size"], pdf["_n"], pdf["_rate"], pdf["_most"], strict=True):
        want = rate * n * size + carry
        copies = min(max(round(want / size), 0), int(most * n)) if size else 0
        carry = want - copies * size
        out.append(copies)
    return pdf[["_s", "size", "_n"]].assign(_copies=out)


def mix_to_weights(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_copies: int = 2,
    id_col: str = "doc_id",
    source_col: str = "source",
    text: str = "text",
    tolerance: float = 1e-6,
    max_iterations: int = 60,
) -> DataFrame:
    """``id, source, size, source_size, target, rate, copies, taken, row_key`` for each row of ``docs``.

    ``weights`` repeat over the sources in code-point order, null last. ``row_key`` is a hash of id and text.
    """
    spark = docs.sparkSession
    size = F.size(words(F.col(text))) if size is None else size
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.cast("long").alias("size"), F.xxhash64(id_col, text).alias("row_key")
    )
    rows = materialise(rows, "mix-rows")
    sums = materialise(rows.groupBy("_source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-sums")
    found = sums.limit(MAX_SOURCES + 1).collect()
    few = len(found) <= MAX_SOURCES
    given = F.broadcast if few else (lambda table: table)
    if few:
        found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
        goals = targets_by_weight([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, max_copies)
        sources = [{"size": r["size"], "target": t, "mean": max(1.0, r["size"] / r["n"])} for r, t in zip(found, goals, strict=True)]
        known = spark.createDataFrame([(i, r["_source"], r["size"], t) for i, (r, t) in enumerate(zip(found, goals, strict=True))], "_s int, _name string, source_size long, target double")
    else:
        of_source = materialise(_table_of_targets(sums, weights, share, max_copies), "mix-targets")
        known = of_source.drop("_mean")
    salt = F.pmod(F.xxhash64("_id"), F.lit(_SALTS)).cast("int")
    keyed = rows.join(given(known), F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_salt", salt)
    salted = materialise(keyed.groupBy("_s", "size", "_salt").agg(F.count(F.lit(1)).alias("_k")), "mix-counts")
    hist = materialise(salted.groupBy("_s", "size").agg(F.sum("_k").alias("_n")), "mix-sizes")

    if few:
        lam = _solve(hist, sources, max_copies, tolerance, max_iterations)
        solved = spark.createDataFrame([(i, min(x, 1e300), s["mean"]) for i, (x, s) in enumerate(zip(lam, sources, strict=True))], "_s int, _lam double, _mean double")
    else:
        each = hist.join(of_source, "_s").select("_s", "size", "_n", "target", "_mean").groupBy("_s").applyInPandas(_solve_there(max_copies, tolerance, max_iterations), "_s int, _lam double")
        solved = materialise(each.join(of_source.select("_s", "_mean"), "_s"), "mix-solved")
    rate = F.when(F.col("_lam") > 1e299, F.lit(float(max_copies))).otherwise(
        F.least(F.lit(float(max_copies)), F.exp(F.least(F.col("_lam") * F.col("size") / F.col("_mean"), F.lit(50.0))))
    )
    rated = hist.join(given(solved), "_s").withColumn("_rate", rate).withColumn("_most", F.lit(max_copies))
    # A group here is the distinct sizes of a source, bounded by its longest document and not by its rows.
    rounded = rated.select("_s", "size", "_n", "_rate", "_most").groupBy("_s").applyInPandas(_round, "_s int, size long, _n long, _copies long")

    # Of a size's copies all its documents get the whole part; the rest goes by salt and then by rank, so that a run of equal sizes is cut.
    sofar = Window.partitionBy("_s", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)
    extra = F.pmod(F.col("_copies"), F.col("_n"))
    upto = lambda cum: F.floor(cum.cast("decimal(38,0)") * extra / F.col("_n")).cast("long")
    dealt = (
        salted.join(rounded, ["_s", "size"])
        .withColumn("_cum", F.sum("_k").over(sofar))
        .select("_s", "size", "_salt", F.floor(F.col("_copies") / F.col("_n")).cast("long").alias("_each"), (upto(F.col("_cum")) - upto(F.col("_cum") - F.col("_k"))).alias("_more"), (F.col("_copies") / F.col("_n")).alias("rate"))
    )
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_salt").orderBy(F.xxhash64("_id", F.lit(1)), "_id", "row_key"))
    copies = F.col("_each") + F.when(rank <= F.col("_more"), 1).otherwise(0)
    out = keyed.join(dealt, ["_s", "size", "_salt"]).withColumn("copies", copies.cast("int"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        "size",
        "source_size",
        "target",
        "rate",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "row_key",
    )


def apply_mix(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix`` says; rows of no copy go, rows equal in id and text share their copies."""
    key, copies, alike, n, copy = fresh(docs, "key", "copies", "alike", "n", "copy")
    per_key = mix.groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(alike)).filter(F.col(copies) > 0)
    joined = docs.withColumn(key, F.xxhash64(id_col, text)).join(per_key, key)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.monotonically_increasing_id()))  # the join has dealt the rows by this key already
    more = F.when(rank <= F.pmod(F.col(copies), F.col(alike)), 1).otherwise(0)
    out = joined.withColumn(n, F.floor(F.col(copies) / F.col(alike)).cast("int") + more).filter(F.col(n) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)
