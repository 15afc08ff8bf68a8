"""Aggregations over matched rows: metrics, and terms, multi-terms, histogram, date-histogram and range buckets, nested.

A spec is a dict such as ``{"terms": {"field": "status", "size": 10}, "aggs": {"avg_price": {"avg": {"field": "price"}}}}``. Each spec is one
``groupBy``; partial aggregation happens before the shuffle. Metrics in buckets are columns; a ``stats`` metric is five of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as q
from ..plans.compile import Compiler, matching

_METRICS = ("value_count", "count", "sum", "avg", "min", "max", "stats", "cardinality", "extended_stats", "percentiles", "top_hits")
_BUCKETS = ("terms", "multi_terms", "histogram", "date_histogram", "range", "filter", "composite")
# Units of a fixed interval, in microseconds.
_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def interval_micros(text: str) -> int:
    m = re.fullmatch(r"([+-]?)(\d+)(ms|s|m|h|d)", text)
    if not m:
        raise ValueError(f"not a fixed interval: {text!r} (units are ms, s, m, h, d)")
    return (-1 if m[1] == "-" else 1) * int(m[2]) * _UNITS[m[3]]


def _kind(spec: dict) -> tuple[str, dict]:
    kinds = [k for k in spec if k in _METRICS + _BUCKETS]
    if len(kinds) != 1:
        raise ValueError(f"one aggregation type is needed, got {sorted(spec)}")
    return kinds[0], spec[kinds[0]]


def metric(name: str, spec: dict, exact: bool = True, schema: T.StructType | None = None) -> list[Column]:
    """The columns of a metric; ``value`` takes the name. Of an array every value that is not null counts."""
    kind, body = _kind(spec)
    if kind not in _METRICS or kind == "top_hits":
        raise ValueError(f"{kind} is not a metric of columns")
    if schema is not None and body["field"] in schema.names and isinstance(schema[body["field"]].dataType, T.ArrayType):
        return _array_metric(name, kind, F.col(f"`{body['field']}`"))
    c = F.col(f"`{body['field']}`")
    if "missing" in body:
        c = F.coalesce(c, F.lit(body["missing"]))
    d = c.cast("double")
    if kind in ("value_count", "count"):
        return [F.count(c).alias(name)]
    if kind == "cardinality":
        return [(F.countDistinct(c) if exact else F.approx_count_distinct(c)).alias(name)]
    simple = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if kind in simple:
        return [simple[kind](d).alias(name)]
    five = [F.count(c).alias(f"{name}_count"), *[simple[k](d).alias(f"{name}_{k}") for k in ("sum", "min", "max", "avg")]]
    if kind == "stats":
        return five
    if kind == "extended_stats":
        return [*five, F.var_pop(d).alias(f"{name}_variance"), F.stddev_pop(d).alias(f"{name}_std_deviation")]
    return [F.percentile_approx(d, float(p) / 100).alias(f"{name}_p{p:g}") for p in body.get("percents", (50, 95, 99))]


def _array_metric(name: str, kind: str, c: Column) -> list[Column]:
    values = F.filter(c, lambda x: x.isNotNull())
    count = F.coalesce(F.sum(F.when(c.isNotNull(), F.size(values)).otherwise(0)), F.lit(0))
    total = F.sum(F.when(F.size(values) > 0, F.aggregate(F.transform(values, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)))
    parts = {"value_count": count, "count": count, "sum": total, "min": F.min(F.array_min(values)).cast("double"), "max": F.max(F.array_max(values)).cast("double"), "avg": total / F.nullif(count, F.lit(0))}
    if kind == "stats":
        return [parts[k].alias(f"{name}_{k}") for k in ("count", "sum", "min", "max", "avg")]
    if kind not in parts:
        raise ValueError(f"{kind} of an array")
    return [parts[kind].alias(name)]


@dataclass
class _Level:
    """A bucket level: its key expression, whether a row can have several keys, and how the table of keys is completed."""

    kind: str
    body: dict
    subs: dict


def _levels(spec: dict) -> list[_Level]:
    """Nested bucket levels from the outside in, each with its metrics."""
    levels: list[_Level] = []
    while True:
        kind, body = _kind(spec)
        subs = spec.get("aggs", spec.get("aggregations", {}))
        inner = {n: s for n, s in subs.items() if _kind(s)[0] in _BUCKETS}
        levels.append(_Level(kind, body, {n: s for n, s in subs.items() if n not in inner}))
        if not inner:
            return levels
        if len(inner) > 1:
            raise ValueError("several bucket aggregations in one bucket are several tables: see aggregate_each")
        spec = next(iter(inner.values()))


def chains(spec: dict, name: str = "agg") -> dict[str, dict]:
    """A tree of bucket aggregations as one chain for each innermost one, by path, such as ``flag>status``. Metrics of a level go with each chain through it."""
    subs = spec.get("aggs", spec.get("aggregations", {}))
    inner = {n: s for n, s in subs.items() if _kind(s)[0] in _BUCKETS}
    own = {n: s for n, s in subs.items() if n not in inner}
    body = {k: v for k, v in spec.items() if k not in ("aggs", "aggregations")}
    if not inner:
        return {name: body | {"aggs": own}}
    return {f"{name}>{path}": body | {"aggs": own | {n: chain}} for n, s in inner.items() for path, chain in chains(s, n).items()}


class Aggregator:
    def __init__(self, df: DataFrame, fields: q.Fields | None = None, exact: bool = True) -> None:
        self.df, self.fields, self.exact = df, fields or q.Fields(tokenizers={}), exact
        self.compiler = Compiler(df.schema, self.fields)

    # ------------------------------------------------------------------ keys
    def _tokenised(self, field: str) -> bool:
        return isinstance(self.df.schema[field].dataType, T.StringType) and field in self.fields.tokenizers and not self.compiler.raw(field)

    def _keyed(self, df: DataFrame, level: _Level, name: str) -> DataFrame:
        b = level.body
        if level.kind == "terms":
            if b.get("size", 10) <= 0:
                raise ValueError("size must be positive")
            c = F.col(f"`{b['field']}`")
            if self._tokenised(b["field"]):
                df = df.withColumn(name, F.explode(F.array_distinct(self.compiler.terms(b["field"]))))
            else:
                df = df.withColumn(name, F.coalesce(c.cast("string"), F.lit(b["missing"])) if "missing" in b else c.cast("string")).filter(F.col(name).isNotNull())
            if "include" in b:
                df = df.filter(F.col(name).isin(list(b["include"])))
            if "exclude" in b:
                df = df.filter(~F.col(name).isin(list(b["exclude"])))
            return df
        c = F.col(f"`{b['field']}`")
        if level.kind == "histogram":
            step, off = float(b["interval"]), float(b.get("offset", 0))
            if step <= 0:
                raise ValueError("interval must be positive")
            df = df.filter(c.isNotNull())
            if hard := b.get("hard_bounds"):
                df = df.filter((c >= hard["min"]) & (c <= hard["max"]))
            return df.withColumn(name, F.floor((c.cast("double") - off) / step) * step + off)
        if level.kind == "date_histogram":
            if "calendar_interval" in b:
                return df.filter(c.isNotNull()).withColumn(name, F.date_trunc(b["calendar_interval"], c).cast("timestamp_ntz"))
            if "fixed_interval" not in b:
                raise ValueError("date_histogram needs fixed_interval")
            step, off = interval_micros(b["fixed_interval"]), interval_micros(b["offset"]) if b.get("offset") else 0
            df = df.filter(c.isNotNull())
            if hard := b.get("hard_bounds"):
                df = df.filter((c >= F.lit(hard["min"]).cast("timestamp_ntz")) & (c <= F.lit(hard["max"]).cast("timestamp_ntz")))
            micros = F.unix_micros(c.cast("timestamp"))
            return df.withColumn(name, F.timestamp_micros(micros - F.pmod(micros - off, F.lit(step))).cast("timestamp_ntz"))
        if level.kind == "range":
            ranges = [{"key": r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}"} | r for r in b["ranges"]]
            tests = [F.when(self._inside(c, r), F.lit(r["key"])) for r in ranges]
            return df.withColumn(name, F.explode(F.array_compact(F.array(*tests))))
        raise ValueError(f"{level.kind} cannot be a bucket level")

    @staticmethod
    def _inside(c: Column, r: dict) -> Column:
        out = c.isNotNull()
        out = out & (c >= r["from"]) if r.get("from") is not None else out
        return out & (c < r["to"]) if r.get("to") is not None else out

    # ------------------------------------------------------------------ buckets
    def buckets(self, spec: dict) -> DataFrame:
        levels = _levels(spec)
        if levels[0].kind == "composite":
            return self.composite(levels)
        if levels[0].kind == "multi_terms":
            if len(levels) > 1:
                raise ValueError("multi_terms holds metrics only")
            metrics = levels[0].subs
            b = levels[0].body
            names = [t["field"] if isinstance(t, dict) else t for t in b.get("terms", b.get("fields", []))]
            if len(names) < 2:
                raise ValueError("multi_terms needs two fields or more")
            levels = [_Level("terms", {"field": f, "size": b.get("size", 10)}, {}) for f in names]
            levels[-1].subs = metrics
        keys = ["key"] if len(levels) == 1 else [f"key_{i}" for i in range(len(levels))]
        df = self.df
        for level, key in zip(levels, keys, strict=True):
            df = self._keyed(df, level, key)
        out = self._grouped(df, keys, levels[-1].subs)
        for depth, level in enumerate(levels):
            if level.kind == "terms":
                out = self._top(df, out, keys, depth, level)
        if len(levels) == 1:
            return self._complete(out, levels[0], keys[0])
        for depth, level in enumerate(levels[:-1]):  # metrics of an outer bucket stand beside each of its inner ones
            if level.subs:
                outer = self._grouped(df, keys[: depth + 1], level.subs).withColumnRenamed("doc_count", f"doc_count_{depth}")
                if clash := set(outer.columns) & set(out.columns) - set(keys):
                    raise ValueError(f"metrics of two levels have the same name: {sorted(clash)}")
                out = out.join(outer, keys[: depth + 1], "left").select(*out.columns, *outer.columns[depth + 1 :])
        return out

    def _grouped(self, df: DataFrame, keys: list[str], metrics: dict[str, dict]) -> DataFrame:
        hits = {n: s["top_hits"] for n, s in metrics.items() if _kind(s)[0] == "top_hits"}
        columns = [c for n, s in metrics.items() if n not in hits for c in metric(n, s, self.exact, self.df.schema)]
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *columns)
        for name, body in hits.items():
            out = out.join(self._hits(df, keys, name, body), keys, "left")
        return out

    def _hits(self, df: DataFrame, keys: list[str], name: str, body: dict) -> DataFrame:
        """The first ``size`` rows of each bucket by ``sort``, as an array of structs of ``_source``; ranks are cut before the shuffle."""
        size, source = body.get("size", 3), body.get("_source") or self.df.columns
        order = [(f, way) for item in body.get("sort", []) for f, way in item.items()]
        by = [F.col(f"`{f}`").desc_nulls_last() if way == "desc" else F.col(f"`{f}`").asc_nulls_last() for f, way in order]
        by += [F.col(f"`{c}`").asc_nulls_last() for c in source if c not in dict(order) and isinstance(self.df.schema[c].dataType, T.AtomicType)]
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_rank") <= size)
        rows = F.sort_array(F.collect_list(F.struct("_rank", F.struct(*[F.col(f"`{c}`") for c in source]).alias("row"))))
        return ranked.groupBy(*keys).agg(F.transform(rows, lambda r: r["row"]).alias(name))

    def composite(self, levels: list[_Level]) -> DataFrame:
        """Buckets of all combinations of the sources' keys, in key order, ``size`` of them after the key ``after``: pages of a whole grouping."""
        if len(levels) > 1:
            raise ValueError("composite holds metrics only")
        body, df, keys = levels[0].body, self.df, []
        for source in body["sources"]:
            (name, inner), *_ = source.items()
            kind, own = _kind(inner)
            df = self._keyed(df, _Level(kind, own, {}), name)
            keys.append(name)
        out = self._grouped(df, keys, levels[0].subs)
        if after := body.get("after"):
            last = F.struct(*[F.lit(after[k]).cast(out.schema[k].dataType).alias(k) for k in keys])
            out = out.filter(F.struct(*keys) > last)
        return out.orderBy(*keys).limit(body.get("size", 10))

    @staticmethod
    def _top(df: DataFrame, out: DataFrame, keys: list[str], depth: int, level: _Level) -> DataFrame:
        """``size`` holds for each parent: the first terms by count, then key (or by key)."""
        size, least = level.body.get("size", 10), level.body.get("min_doc_count", 1)
        order = level.body.get("order") or {"_count": "desc"}
        (by, way), *_ = order.items()
        last = depth == len(keys) - 1
        here = keys[: depth + 1]
        table = out if last else out.groupBy(*here).agg(F.sum("doc_count").alias("doc_count"))
        table = table.filter(F.col("doc_count") >= least)
        first = F.col(keys[depth]) if by in ("_key", "_term") else F.col("doc_count" if by == "_count" else by)
        ordering = [first.desc() if way == "desc" else first.asc(), F.col(keys[depth]).asc()]
        if depth == 0:
            table = table.orderBy(*ordering).limit(size)
        else:
            table = table.withColumn("_r", F.row_number().over(Window.partitionBy(*keys[:depth]).orderBy(*ordering))).filter(F.col("_r") <= size).drop("_r")
        return table if last else out.join(table.select(*here), here, "left_semi")

    def _complete(self, out: DataFrame, level: _Level, key: str) -> DataFrame:
        b = level.body
        if level.kind == "range":
            rows = [(r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}", *(None if r.get(k) is None else float(r[k]) for k in ("from", "to"))) for r in b["ranges"]]
            table = out.sparkSession.createDataFrame(rows, "key string, `from` double, `to` double")
            return F.broadcast(table).join(out, key, "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long"))) if rows else out
        if level.kind not in ("histogram", "date_histogram"):
            return out
        least = b.get("min_doc_count", 0)
        if least > 0:
            if b.get("extended_bounds"):
                raise ValueError("extended_bounds cannot be combined with min_doc_count")
            return out.filter(F.col("doc_count") >= least)
        if "calendar_interval" in b:
            return out
        bounds, extra = out.agg(F.min(key).alias("lo"), F.max(key).alias("hi")), b.get("extended_bounds")
        if level.kind == "histogram":
            step, off = float(b["interval"]), float(b.get("offset", 0))
            lo, hi = F.col("lo"), F.col("hi")
            if extra:
                snap = lambda v: F.lit(float((v - off) // step * step + off))
                lo, hi = F.least(lo, snap(extra["min"])), F.greatest(hi, snap(extra["max"]))
            number = lambda c: F.round((c - off) / step).cast("long")
            grid = bounds.select(F.explode(F.sequence(number(lo), number(hi))).alias("_k")).select("_k")
            joined = grid.join(out.withColumn("_k", number(F.col(key))).drop(key), "_k", "left").withColumn(key, F.col("_k") * step + off)
        else:
            step = interval_micros(b["fixed_interval"])
            micros = lambda c: F.unix_micros(c.cast("timestamp"))
            lo, hi = micros(F.col("lo")), micros(F.col("hi"))
            grid = bounds.filter("lo is not null").select(F.explode(F.sequence(lo, hi, F.lit(step))).alias("_k"))
            joined = grid.join(out.withColumn("_k", micros(F.col(key))).drop(key), "_k", "left").withColumn(key, F.timestamp_micros("_k").cast("timestamp_ntz"))
        return joined.withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long"))).select(key, *[c for c in out.columns if c != key])

    def run(self, name: str, spec: dict) -> DataFrame:
        kind, body = _kind(spec)
        if kind in _METRICS:
            if kind == "top_hits":
                one = self.df.withColumn("_all", F.lit(0))
                return Aggregator(one, self.fields, self.exact)._hits(one, ["_all"], "value", body | {"_source": body.get("_source") or self.df.columns}).select("value")
            columns = metric("value", spec, self.exact, self.df.schema)
            names = [c.strip() for c in ("count", "sum", "min", "max", "avg")]
            out = self.df.agg(*columns)
            return out.toDF(*[c.removeprefix("value_") for c in out.columns]) if kind in ("stats", "extended_stats") and names else out
        if kind == "filter":
            inner = Aggregator(matching(self.df, body if isinstance(body, q.Query) else q.Query.from_json(body), self.fields), self.fields, self.exact)
            return inner.df.agg(F.count(F.lit(1)).alias("doc_count"), *[c for n, s in spec.get("aggs", {}).items() for c in metric(n, s, self.exact, self.df.schema)])
        return self.buckets(spec)


def aggregate(df: DataFrame, spec: dict, query: q.Query | None = None, fields: q.Fields | None = None, exact: bool = True) -> DataFrame:
    """One aggregation over the rows that ``query`` matches."""
    rows = matching(df, query, fields) if query is not None else df
    return Aggregator(rows, fields, exact).run("agg", spec)


def aggregate_all(df: DataFrame, specs: dict[str, dict], query: q.Query | None = None, fields: q.Fields | None = None, exact: bool = True) -> dict[str, DataFrame]:
    """Several aggregations; all metrics share one pass (under ``_metrics``)."""
    rows = matching(df, query, fields) if query is not None else df
    metrics = {n: s for n, s in specs.items() if _kind(s)[0] in _METRICS}
    out = {n: Aggregator(rows, fields, exact).run(n, s) for n, s in specs.items() if n not in metrics}
    if metrics:
        out["_metrics"] = rows.agg(*[c for n, s in metrics.items() for c in metric(n, s, exact, rows.schema)])
    return out


def aggregate_each(df: DataFrame, spec: dict, name: str = "agg", query: q.Query | None = None, fields: q.Fields | None = None, exact: bool = True) -> dict[str, DataFrame]:
    """A bucket aggregation that holds several others, as a table for each innermost one, by path."""
    rows = matching(df, query, fields) if query is not None else df
    return {path: Aggregator(rows, fields, exact).run(path, chain) for path, chain in chains(spec, name).items()}


def sum_other_doc_count(df: DataFrame, spec: dict, fields: q.Fields | None = None) -> DataFrame:
    """Rows with a key that is not among the returned terms."""
    level = _Level("terms", spec["terms"], {})
    a = Aggregator(df, fields)
    every = a._keyed(df, level, "key").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))
    return every.join(a.buckets(spec).select("key"), "key", "left_anti").agg(F.coalesce(F.sum("doc_count"), F.lit(0).cast("long")).alias("value"))


def schema_of(df: DataFrame, spec: dict, fields: q.Fields | None = None) -> T.StructType:
    """The result's schema, without running anything."""
    return aggregate(df, spec, None, fields).schema


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))
