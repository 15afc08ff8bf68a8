"""The file log as a Spark data source: ``rows(spark, table, where, columns)``.

Planning reads the published state's index, prunes manifests with the filter, and hands out one partition for each manifest, or several of about PARTITION_BYTES of its files; a task
opens its manifest, takes tombstones and later removes away, prunes files by partition values and bounds, and reads what is left with the filter given to the row groups. So neither the driver nor any
task holds the table's file list; a task holds one manifest. Files added since the last state are dealt out in groups.

The filter is an option of the source, not one that Spark pushes: Spark 4.1 keeps the filters pushed into a Python source for all later queries over the same DataFrame, which
then lose rows (a filtered count before a whole one shows it). Spark prunes no columns of a Python source either: name the ones you need, and only these are read. A column ``_file`` of type string gets the file's path.
The filter is applied again after the scan, so pruning only ever leaves out what cannot match. Bounds of timestamps are texts without a zone and prune nothing. Paths must be of a file system that pyarrow opens.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import Filter

#: Files of about these bytes make a partition; a group of files added since the last state has at most so many.
PARTITION_BYTES, GROUP = 256 << 20, 1000


#: Filters of the log's dialect that prune, as Spark's.
_OPS = {"eq": ds.EqualTo, "in": ds.In, "gt": ds.GreaterThan, "gte": ds.GreaterThanOrEqual, "lt": ds.LessThan, "lte": ds.LessThanOrEqual, "starts_with": ds.StringStartsWith, "is_null": ds.IsNull, "is_not_null": ds.IsNotNull}


def rows(spark: SparkSession, table: str, where: Filter | None = None, columns: str | None = None) -> DataFrame:
    """The rows of a table's live files for which ``where`` holds; ``columns`` are those to read, with their types, and hold those of ``where``."""
    spark.dataSource.register(LogSource)
    reader = spark.read.format(LogSource.name())
    reader = reader.schema(columns) if columns else reader
    if where is None:
        return reader.load(table)
    out = reader.option("where", json.dumps([[f.op, f.column, [str(v) for v in f.value] if f.op == "in" else None if f.value is None else str(f.value)] for f in _conjuncts(where)])).load(table)
    return out.filter(holds(where))


def _conjuncts(f: Filter) -> list[Filter]:
    """The parts of a conjunction that can prune."""
    if f.op == "and":
        return [c for p in f.parts for c in _conjuncts(p)]
    return [f] if f.op in _OPS else []


def holds(f: Filter) -> Column:
    """The filter on typed columns, null where it can't be told, as in SQL."""
    if f.op in ("and", "or"):
        return reduce((lambda a, b: a & b) if f.op == "and" else (lambda a, b: a | b), [holds(p) for p in f.parts])
    if f.op == "not":
        return ~holds(f.parts[0])
    c = F.col(f.column)
    return {
        "eq": lambda: c == f.value, "neq": lambda: c != f.value, "in": lambda: c.isin(list(f.value)), "gt": lambda: c > f.value, "gte": lambda: c >= f.value, "lt": lambda: c < f.value, "lte": lambda: c <= f.value,
        "is_null": c.isNull, "is_not_null": c.isNotNull, "starts_with": lambda: c.startswith(f.value), "ends_with": lambda: c.endswith(f.value), "contains": lambda: c.contains(f.value),
    }[f.op]()


# ---------------------------------------------------------------------- the log, read without Spark
class LogFiles:
    """The log's files through pyarrow."""

    def __init__(self, table: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(f"{table.rstrip('/')}/_log") if re.match(r"[a-z0-9]+:", table) else (fs.LocalFileSystem(), f"{table.rstrip('/')}/_log")

    def text(self, name: str) -> str:
        with self.fs.open_input_stream(f"{self.root}/{name}") as file:
            return file.read().decode()

    def names(self) -> list[str]:
        from pyarrow import fs

        return [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.root))]

    def head(self) -> tuple[dict | None, list[int]]:
        """The last published state and the versions after it."""
        names = self.names()
        published = max((int(n[6:-5]) for n in names if re.fullmatch(r"_last-\d+\.json", n)), default=None)
        versions = sorted(int(n[:20]) for n in names if re.fullmatch(r"\d{20}\.json", n))
        state = None if published is None else json.loads(self.text(f"_last-{published}.json"))
        return state, [v for v in versions if published is None or v > published]

    def since(self, versions: Sequence[int]) -> Iterator[dict]:
        for v in versions:
            yield from (json.loads(line) for line in self.text(f"{v:020d}.json").splitlines())

    def table(self, name: str, columns: list[str] | None = None, filter=None):  # noqa: A002
        from pyarrow import dataset

        return dataset.dataset(f"{self.root}/{name}", filesystem=self.fs, format="parquet").to_table(columns=columns, filter=filter)


def latest(actions: Iterator[dict]) -> dict[str, dict]:
    """The last add or remove of each path; ``actions`` come in order."""
    return {a["path"]: a for a in actions if a["action"] in ("add", "remove")}


# ---------------------------------------------------------------------- pruning
def typed(text: str | None, kind: T.DataType):
    """A partition value or bound as the column's type; ``...`` if it cannot be told."""
    if text is None:
        return None
    try:
        if isinstance(kind, T.IntegralType):
            return int(text)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(text)
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(text)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}[text.lower()]
        return text if isinstance(kind, T.StringType) else ...
    except (ValueError, KeyError, decimal.InvalidOperation):
        return ...


def between(f: ds.Filter, low, high, cut: bool = False) -> bool:
    """Whether values of [low, high] may satisfy a filter; ``cut``: the upper bound may be the beginning of a longer text."""
    if low in (None, ...) or high in (None, ...):
        return True
    above = lambda v: v > high and not (cut and isinstance(v, str) and v.startswith(high))
    try:
        if isinstance(f, ds.EqualTo):
            return low <= f.value and not above(f.value)
        if isinstance(f, ds.In):
            return any(v is not None and low <= v and not above(v) for v in f.value)
        if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
            return not above(f.value)
        if isinstance(f, ds.LessThan):
            return low < f.value
        if isinstance(f, ds.LessThanOrEqual):
            return low <= f.value
        if isinstance(f, ds.StringStartsWith):
            return low[: len(f.value)] <= f.value <= high or high.startswith(f.value)
    except TypeError:  # a literal of another type
        return True
    return True


def exactly(f: ds.Filter, value) -> bool:
    """Whether one partition value may satisfy a filter."""
    if value is ...:
        return True
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, ds.GreaterThan):
        return between(f, value, value) and value != f.value
    return between(f, value, value)


def manifest_may(f: ds.Filter, bound: dict | None, kind: T.DataType) -> bool:
    """Whether a manifest of these bounds may hold a file for a filter."""
    if bound is None:
        return True
    if isinstance(f, ds.IsNull):
        return bound["nulls"] > 0
    if isinstance(kind, (T.IntegralType, T.DoubleType, T.FloatType)):
        return bound["odd"] > 0 or between(f, bound["nlo"], bound["nhi"])
    if isinstance(kind, (T.StringType, T.DateType)):
        return between(f, typed(bound["lo"], kind), typed(bound["hi"], kind))
    return True


def _name(f: ds.Filter) -> str:
    return f.attribute[0]


# ---------------------------------------------------------------------- the source
@dataclass
class Group(ds.InputPartition):
    """The ``index``-th of ``of`` slices of a manifest's files, with the state and the later versions that say which live; or a list of files added since."""

    manifest: str | None = None
    index: int = 0
    of: int = 1
    state: str = ""
    versions: tuple = ()
    files: tuple = ()

    def __post_init__(self) -> None:
        self.value = (self.manifest, self.index)


class LogSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_log"

    def schema(self) -> T.StructType | str:
        log = LogFiles(self.options["path"])
        state, versions = log.head()
        found = [a for a in log.since(versions) if a["action"] == "metaData"]
        if not found and state is not None:
            found = [a for a in log.table(f"{state['path']}/rest").to_pylist() if a["action"] == "metaData"]
        text = (found[-1].get("schemaString") or "") if found else ""
        if text.strip() in ("", "{}"):
            raise ValueError("the log's metadata holds no schema: give one with .schema(...)")
        return T.StructType.fromJson(json.loads(text)) if text.lstrip().startswith("{") else text

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options["path"], schema, json.loads(self.options.get("where", "[]")))


class LogReader(ds.DataSourceReader):
    def __init__(self, table: str, schema: T.StructType, where: list) -> None:
        self.table, self.schema, self.filters = table, schema, []
        for op, column, value in where:
            if column not in schema.names:
                raise ValueError(f"the filter's column {column!r} is not read")
            kind = schema[column].dataType
            if op in ("is_null", "is_not_null"):
                self.filters.append(_OPS[op]((column,)))
            elif op == "in":
                values = [typed(v, kind) for v in value]
                if ... not in values:
                    self.filters.append(ds.In((column,), tuple(values)))
            elif (one := typed(value, kind)) not in (None, ...):
                self.filters.append(_OPS[op]((column,), one))

    def _kind(self, name: str) -> T.DataType:
        return self.schema[name].dataType

    def partitions(self) -> list[Group]:
        log = LogFiles(self.table)
        state, versions = log.head()
        out = []
        if state is not None and state["manifests"]:
            for m in log.table(f"{state['path']}/manifests").to_pylist():  # one row for up to 50,000 files
                bounds = dict(m["bounds"])
                if all(manifest_may(f, bounds.get(_name(f)), self._kind(_name(f))) for f in self.filters):
                    n = max(1, min(m["entries"], -(-(m["bytes"] or 0) // PARTITION_BYTES)))
                    out += [Group(m["path"], i, n, state["path"], tuple(versions)) for i in range(n)]
        added = [a for a in latest(log.since(versions)).values() if a["action"] == "add" and self._wanted(a)]
        group, size = [], 0
        for a in added:
            if group and (len(group) == GROUP or size + (a.get("size") or 0) > PARTITION_BYTES):
                out.append(Group(files=tuple(group)))
                group, size = [], 0
            group.append({"path": a["path"], "partitionValues": a.get("partitionValues") or {}})
            size += a.get("size") or 0
        return [*out, Group(files=tuple(group))] if group or not out else out

    def _wanted(self, entry: dict) -> bool:
        """Whether a file may hold a row for the filters: by its partition values, else by its bounds."""
        values = dict(entry.get("partitionValues") or {})
        low, high = dict(entry.get("minValues") or {}), dict(entry.get("maxValues") or {})
        for f in self.filters:
            name = _name(f)
            kind = self._kind(name)
            if name in values:
                if not exactly(f, typed(values[name], kind)):
                    return False
            elif name in low and not between(f, typed(low[name], kind), typed(high.get(name), kind), cut=True):
                return False
        return True

    def _entries(self, part: Group) -> list[dict]:
        """A task's files."""
        if part.manifest is None:
            return list(part.files)
        from pyarrow import compute as pc

        log = LogFiles(self.table)
        rows = log.table(part.manifest, ["path", "version", "partitionValues", "minValues", "maxValues"]).to_pylist()
        own = [r for k, r in enumerate(rows) if k % part.of == part.index and self._wanted(r)]
        if not own:
            return []
        touched = latest(log.since(part.versions))
        paths = [r["path"] for r in own]
        span = (pc.field("path") >= min(paths)) & (pc.field("path") <= max(paths)) & ~pc.field("applied")
        dead = {r["path"]: r["before"] for r in log.table(f"{part.state}/removed", ["path", "before"], span).to_pylist()}
        return [r for r in own if r["path"] not in touched and r["version"] >= dead.get(r["path"], 0)]

    def read(self, partition: Group) -> Iterator:
        import pyarrow as pa
        from pyarrow import dataset, fs
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        for entry in self._entries(partition):
            values = dict(entry["partitionValues"] or {})
            system, path = fs.FileSystem.from_uri(quote(entry["path"], safe=":/"))
            data = dataset.dataset(path, filesystem=system, format="parquet")
            columns = [f.name for f in target if f.name in data.schema.names and f.name not in values]
            for batch in data.to_batches(columns=columns, filter=self._row_filter(data.schema, values)):
                arrays = []
                for f in target:
                    if f.name in columns:
                        array = batch.column(f.name)
                        arrays.append(array if array.type == f.type else array.cast(f.type))
                    else:
                        value = entry["path"] if f.name == "_file" else values.get(f.name)
                        arrays.append(pa.nulls(batch.num_rows, f.type) if value is None else pa.repeat(pa.scalar(value), batch.num_rows).cast(f.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=target) if arrays else pa.RecordBatch.from_struct_array(pa.array([{}] * batch.num_rows, pa.struct([])))

    def _row_filter(self, schema, values: dict):
        """The filters on columns of the file that pyarrow can use on row groups."""
        from pyarrow import compute as pc

        out = None
        for f in self.filters:
            name = _name(f)
            if name in values or name not in schema.names or isinstance(self._kind(name), (T.TimestampType, T.TimestampNTZType)):
                continue
            c = pc.field(name)
            made = {ds.EqualTo: lambda c=c, f=f: c == f.value, ds.GreaterThan: lambda c=c, f=f: c > f.value, ds.GreaterThanOrEqual: lambda c=c, f=f: c >= f.value, ds.LessThan: lambda c=c, f=f: c < f.value,
                    ds.LessThanOrEqual: lambda c=c, f=f: c <= f.value, ds.In: lambda c=c, f=f: c.isin([v for v in f.value if v is not None]), ds.IsNull: lambda c=c: c.is_null(), ds.IsNotNull: lambda c=c: c.is_valid()}.get(type(f))
            if made is not None:
                out = made() if out is None else out & made()
        return out
