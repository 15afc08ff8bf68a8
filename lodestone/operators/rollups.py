"""Stored partial aggregates: counts, sums and mergeable sketches by key and part, put together at query time.

A part of a table is aggregated once, by the finest keys that will be asked for; a query merges the rows of all parts for coarser keys and never reads the table again. Counts, sums,
least and greatest values merge exactly; distinct values by a HyperLogLog sketch of 2^PRECISION registers (standard error 1.04 / sqrt(2^PRECISION), 0.8 %), percentiles by a KLL sketch of
parameter WIDTH (rank error below 1 % with 99 % confidence). Merging sketches of parts gives the same guarantees as a sketch of the whole; both are as large as their parameter, however many rows they stand for.
Everything runs in the JVM. Writing a part again replaces it; so parts may be dropped or redone one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as q
from ..plans.compile import matching

#: Registers of distinct counts as a power of two; parameter of percentile sketches.
PRECISION, WIDTH = 14, 400


class Rollup:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def write(df: DataFrame, path: str, keys: list[str], fields: list[str], part: str = "0") -> Rollup:
        """Aggregate one part by ``keys``. Numbers get sums and percentiles, all fields counts, bounds and distinct values; nulls and NaN are left out."""
        out = Rollup(df.sparkSession, path)
        aggs = [F.count(F.lit(1)).alias("rows")]
        for f in fields:
            kind = df.schema[f].dataType
            c = F.col(f"`{f}`")
            numeric = isinstance(kind, T.NumericType)
            c = F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
            hashed = c if isinstance(kind, (T.StringType, T.IntegerType, T.LongType, T.BinaryType)) else c.cast("string")
            aggs += [F.count(c).alias(f"{f}.count"), F.min(c).alias(f"{f}.min"), F.max(c).alias(f"{f}.max"), F.hll_sketch_agg(hashed, PRECISION).alias(f"{f}.distinct")]
            if numeric:
                d = c.cast("double")
                aggs += [F.sum(d).alias(f"{f}.sum"), F.sum(d * d).alias(f"{f}.squares"), F.kll_sketch_agg_double(d, WIDTH).alias(f"{f}.ranks")]
        df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs).write.mode("overwrite").parquet(f"{out.path}/part={part}")
        return out

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def merge(self, path: str) -> Rollup:
        """All parts as one, at a new place."""
        rows = self.table()
        keys, fields = self._shape(rows)
        merged = self._merged(rows, keys, fields)
        merged.write.parquet(f"{path.rstrip('/')}/part=0")
        return Rollup(self.spark, path)

    @staticmethod
    def _shape(rows: DataFrame) -> tuple[list[str], list[str]]:
        names = rows.columns
        return names[: names.index("rows")], [n.removesuffix(".count") for n in names if n.endswith(".count")]

    @staticmethod
    def _merged(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
        aggs = [F.sum("rows").alias("rows")]
        for f in fields:
            col = lambda name, f=f: F.col(f"`{f}.{name}`")
            aggs += [F.sum(col("count")).alias(f"{f}.count"), F.min(col("min")).alias(f"{f}.min"), F.max(col("max")).alias(f"{f}.max"), F.hll_union_agg(col("distinct")).alias(f"{f}.distinct")]
            if f"{f}.ranks" in rows.columns:
                aggs += [F.sum(col("sum")).alias(f"{f}.sum"), F.sum(col("squares")).alias(f"{f}.squares"), F.kll_merge_agg_double(col("ranks"), WIDTH).alias(f"{f}.ranks")]
        return rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)

    def aggregate(self, metrics: dict[str, dict], by: list[str] | None = None, query: q.Query | None = None) -> DataFrame:
        """Metrics ``{name: {kind: {"field": ...}}}`` for the keys ``by`` (all rows without), of the rollup's rows whose keys match ``query``.

        Kinds: value_count, sum, avg, min, max, variance, cardinality, percentiles (``percents``), and doc_count without a field.
        """
        rows = self.table()
        keys, fields = self._shape(rows)
        if unknown := set(by or []) - set(keys):
            raise ValueError(f"not keys of the rollup: {sorted(unknown)}")
        if query is not None:
            if unknown := query.fields_used() - set(keys):
                raise ValueError(f"a rollup is filtered by its keys only, not by {sorted(unknown)}")
            rows = matching(rows, query)
        return self._merged(rows, by or [], fields).select(*[F.col(f"`{k}`") for k in by or []], *[c for name, body in metrics.items() for c in self._metric(name, body, rows.columns)])

    @staticmethod
    def _metric(name: str, body: dict, columns: list[str]) -> list[Column]:
        ((kind, options),) = body.items()
        if kind == "doc_count":
            return [F.coalesce(F.col("rows"), F.lit(0)).alias(name)]
        field = options["field"]
        if f"{field}.count" not in columns:
            raise ValueError(f"the rollup doesn't hold {field!r}")
        col = lambda part: F.col(f"`{field}.{part}`")
        if kind not in ("value_count", "min", "max", "cardinality") and f"{field}.ranks" not in columns:
            raise ValueError(f"{kind} needs numbers, {field!r} has none")
        n = col("count")
        if kind == "percentiles":
            ranks = F.when(n > 0, col("ranks"))
            return [F.kll_sketch_get_quantile_double(ranks, F.lit(float(p) / 100)).alias(f"{name}_p{p:g}") for p in options.get("percents", (50, 95, 99))]
        out = {
            "value_count": lambda: F.coalesce(n, F.lit(0)), "sum": lambda: col("sum"), "avg": lambda: col("sum") / F.when(n > 0, n), "min": lambda: col("min"), "max": lambda: col("max"),
            "variance": lambda: F.greatest(F.lit(0.0), col("squares") / F.when(n > 0, n) - (col("sum") / F.when(n > 0, n)) ** 2), "cardinality": lambda: F.coalesce(F.hll_sketch_estimate(col("distinct")), F.lit(0)),
        }
        if kind not in out:
            raise ValueError(f"a rollup has no metric {kind!r}")
        return [out[kind]().alias(name)]
