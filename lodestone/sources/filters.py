"""Partition filters and min/max skipping over string values.

Two dialects differ: ``reader`` compares by the filter's declared type (default string), ``log`` is numeric-aware. Both are two-valued.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """``op`` is eq, neq, in, gt, gte, lt, lte, is_null, is_not_null, starts_with, ends_with, contains, and, or, not."""

    op: str
    column: str = ""
    value: object = None
    type: str = "string"
    parts: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", parts=(self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", parts=(self, other))

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def _compare(op: str, c: Column, value: object, dialect: str, kind: str) -> Column:
    text = F.lit(str(value))
    plain = _ordered(op, c, text)
    if dialect == "reader":
        if kind not in ("long", "double"):
            return plain
        a, b = c.try_cast(kind), text.try_cast(kind)
        return F.when(a.isNotNull() & b.isNotNull(), _ordered(op, a, b)).otherwise(plain)
    i, d = (c.try_cast("bigint"), text.try_cast("bigint")), (c.try_cast("double"), text.try_cast("double"))
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    return F.when(both(i), _ordered(op, *i)).when(both(d), _ordered(op, *d)).otherwise(plain)


def compile_filter(f: Filter, values: Column, dialect: str = "log") -> Column:
    """The filter on a map of partition values."""
    if f.op in ("and", "or"):
        return reduce((lambda a, b: a & b) if f.op == "and" else (lambda a, b: a | b), [compile_filter(p, values, dialect) for p in f.parts])
    if f.op == "not":
        return ~compile_filter(f.parts[0], values, dialect)
    c = F.try_element_at(values, F.lit(f.column))
    if f.op in ("is_null", "is_not_null"):
        absent = c.isNull() | (c == "" if dialect == "log" else F.lit(False))
        absent = F.coalesce(absent, F.lit(True))
        return absent if f.op == "is_null" else ~absent
    if f.op == "neq":
        return F.coalesce(c != F.lit(str(f.value)), F.lit(True))
    if f.op == "eq":
        out = c == F.lit(str(f.value))
    elif f.op == "in":
        out = c.isin([str(v) for v in f.value])  # type: ignore[union-attr]
    elif f.op in ("starts_with", "ends_with", "contains"):
        if dialect == "reader":
            raise ValueError(f"{f.op} is not of the reader's dialect")
        out = {"starts_with": c.startswith, "ends_with": c.endswith, "contains": c.contains}[f.op](str(f.value))
    else:
        out = _compare(f.op, c, f.value, dialect, f.type)
    return F.coalesce(out, F.lit(False))


def may_match(f: Filter, low: Column, high: Column, kinds: dict[str, str] | None = None) -> Column:
    """Whether a file whose columns lie between the maps ``low`` and ``high`` may hold a match: false only where none can be.

    ``kinds`` names columns of type long, double, date, timestamp or timestamp_ntz; others compare as text. Negations, null tests and text
    searches never skip a file; nor does what has no bounds or does not parse. A timestamp's bounds are instants only if they carry their offset: bounds without
    one, of an unknown zone, never skip; a filter's value without one is in the session's zone, as everywhere in Spark.
    """
    if f.op == "and":
        return reduce(lambda a, b: a & b, [may_match(p, low, high, kinds) for p in f.parts])
    if f.op == "or":
        return reduce(lambda a, b: a | b, [may_match(p, low, high, kinds) for p in f.parts])
    if f.op not in ("eq", "in", "gt", "gte", "lt", "lte"):
        return F.lit(True)
    kind = (kinds or {}).get(f.column, "string")
    typed = (lambda c: c) if kind == "string" else (lambda c: c.try_cast(kind))
    bound = (lambda c: typed(F.when(c.rlike(_OFFSET), c))) if kind == "timestamp" else typed
    lo, hi = bound(F.try_element_at(low, F.lit(f.column))), bound(F.try_element_at(high, F.lit(f.column)))
    # the upper bound of a text may be cut short: any value that begins with it is still possible
    above = lambda v: (hi < v) & ~v.startswith(hi) if kind == "string" else hi < v
    if f.op in ("eq", "in"):
        values = [typed(F.lit(str(v))) for v in (f.value if f.op == "in" else [f.value])]  # type: ignore[union-attr]
        return F.coalesce(reduce(lambda a, b: a | b, [~((lo > v) | above(v)) for v in values], F.lit(False)), F.lit(True))
    v = typed(F.lit(str(f.value)))
    out = {"gt": ~(above(v) | ((hi == v) if kind != "string" else F.lit(False))), "gte": ~above(v), "lt": ~(lo >= v), "lte": ~(lo > v)}[f.op]
    return F.coalesce(out, F.lit(True))


#: A timestamp's text that names its offset.
_OFFSET = r"\d(Z|[+-]\d\d:?\d\d)$"


def _instant(c: Column) -> Column:
    """An instant as text in UTC, with its offset: the same in every session."""
    return F.concat(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")).cast("string"), F.lit("+00:00"))


def bounds_of(df, name: str, limit: int = 64) -> list:
    """Least and greatest value of a column as text, ``min_`` and ``max_`` its name; NaN is left out, instants are written in UTC with their offset, texts are cut at ``limit`` characters, which the upper bound's reader allows for."""
    kind = df.schema[name].dataType.simpleString()
    v = F.col(name)
    v = F.when(~F.isnan(v), v) if kind in ("double", "float") else F.substring(v, 1, limit) if kind == "string" else v
    if kind == "timestamp":
        return [_instant(F.min(v)).alias(f"min_{name}"), _instant(F.max(v)).alias(f"max_{name}")]
    return [F.min(v).cast("string").alias(f"min_{name}"), F.max(v).cast("string").alias(f"max_{name}")]


def column_statistics(df, columns: list[str], limit: int = 64):
    """Per file of a DataFrame read from files: rows, null counts and bounds."""
    aggs = [F.count(F.lit(1)).alias("num_records")]
    for c in columns:
        aggs += [*bounds_of(df, c, limit), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(*aggs)


def overlaps(low: Column, high: Column, lower: object, upper: object) -> Column:
    out = F.lit(True)
    out = out & (high >= F.lit(lower)) if lower is not None else out
    return out & (low <= F.lit(upper)) if upper is not None else out
