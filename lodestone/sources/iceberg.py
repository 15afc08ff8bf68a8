"""Iceberg tables read from their metadata: snapshots, manifests and data files. Manifests are Avro, read by a small reader of our own."""

from __future__ import annotations

import datetime
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import field_ids
from .datasource import holds
from .filters import Filter


class _Avro:
    """Object container files with null or deflate blocks."""

    def __init__(self, data: bytes) -> None:
        self.b = io.BytesIO(data)
        if self.b.read(4) != b"Obj\x01":
            raise ValueError("not an Avro file")
        meta = self.value({"type": "map", "values": "bytes"})
        self.schema, self.codec, self.sync = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), self.b.read(16)
        self.names: dict[str, dict] = {}

    def long(self) -> int:
        shift = out = 0
        while True:
            byte = self.b.read(1)[0]
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 128:
                return (out >> 1) ^ -(out & 1)

    def value(self, s):
        if isinstance(s, list):
            return self.value(s[self.long()])
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self.value(kind)
        if isinstance(s, dict) and "name" in s:
            self.__dict__.setdefault("names", {})[s["name"]] = s
        if kind == "null":
            return None
        if kind == "boolean":
            return self.b.read(1) == b"\x01"
        if kind in ("int", "long"):
            return self.long()
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", self.b.read(4 if kind == "float" else 8))[0]
        if kind in ("bytes", "string"):
            raw = self.b.read(self.long())
            return raw if kind == "bytes" else raw.decode()
        if kind == "fixed":
            return self.b.read(s["size"])
        if kind == "enum":
            return s["symbols"][self.long()]
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in s["fields"]}
        if kind in ("array", "map"):
            out: list = []
            while n := self.long():
                if n < 0:
                    n = -n
                    self.long()
                for _ in range(n):
                    out.append(self.value(s["items"]) if kind == "array" else (self.value("string"), self.value(s["values"])))
            return out if kind == "array" else dict(out)
        return self.value(self.names[kind])

    def __iter__(self) -> Iterator[dict]:
        while head := self.b.read(1):
            self.b.seek(-len(head), 1)
            n, size = self.long(), self.long()
            block, outer = self.b.read(size), self.b
            self.b = io.BytesIO(zlib.decompress(block, -15) if self.codec == "deflate" else block)
            for _ in range(n):
                yield self.value(self.schema)
            self.b = outer
            if self.b.read(16) != self.sync:
                raise ValueError("an Avro block is damaged")


def read_avro(data: bytes) -> list[dict]:
    return list(_Avro(data))


# ---------------------------------------------------------------------- bounds
_EPOCH = datetime.date(1970, 1, 1)
# How a single value is written, little-endian.
_PACKED = {"int": "<i", "long": "<q", "float": "<f", "double": "<d"}


def decode(kind: str, raw: bytes | None):
    """A bound of a column of that type; None if there is none, or it is of a type that isn't compared here (timestamps, decimals)."""
    if raw is None:
        return None
    if kind in _PACKED and len(raw) == struct.calcsize(_PACKED[kind]):
        return struct.unpack(_PACKED[kind], raw)[0]
    if kind == "date" and len(raw) == 4:
        return _EPOCH + datetime.timedelta(days=struct.unpack("<i", raw)[0])
    if kind == "boolean" and len(raw) == 1:
        return raw != b"\x00"
    return raw.decode() if kind == "string" else None


def possible(f: Filter, low, high, nulls: bool = True) -> bool:
    """Whether values between the bounds may satisfy a comparison; bounds of texts may be cut, the upper one then is raised, so they hold as they are."""
    if f.op == "is_null":
        return nulls
    if low is None or high is None:
        return True
    try:
        if f.op in ("eq", "in"):
            return any(low <= v <= high for v in (f.value if f.op == "in" else [f.value]) if v is not None)
        return {"gt": lambda: high > f.value, "gte": lambda: high >= f.value, "lt": lambda: low < f.value, "lte": lambda: low <= f.value}.get(f.op, lambda: True)()
    except TypeError:  # a literal of another type
        return True


def conjuncts(f: Filter | None) -> list[Filter]:
    if f is None:
        return []
    return [c for p in f.parts for c in conjuncts(p)] if f.op == "and" else [f] if f.column and f.op != "not" else []


class IcebergTable:
    def __init__(self, spark: SparkSession, metadata_json: str) -> None:
        """``metadata_json`` is the path of a table's metadata file."""
        self.spark = spark
        self.metadata = json.loads(spark.read.option("wholetext", "true").text(metadata_json).first()[0])

    def current_snapshot_id(self) -> int | None:
        return self.metadata.get("current-snapshot-id")

    def snapshots(self) -> DataFrame:
        rows = [(s["snapshot-id"], s.get("parent-snapshot-id"), s["timestamp-ms"], s.get("manifest-list"), json.dumps(s.get("summary", {}))) for s in self.metadata.get("snapshots", [])]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent_id long, timestamp_ms long, manifest_list string, summary string")

    def schema(self, snapshot_id: int | None = None) -> list[dict]:
        wanted = next((s.get("schema-id") for s in self.metadata.get("snapshots", []) if s["snapshot-id"] == snapshot_id), None)
        wanted = self.metadata.get("current-schema-id", 0) if wanted is None else wanted
        found = next((s for s in self.metadata.get("schemas", []) if s.get("schema-id") == wanted), self.metadata.get("schema", {}))
        return found.get("fields", [])

    def _avro(self, paths: list[str]) -> list[tuple[str, list[dict]]]:
        raw = self.spark.read.format("binaryFile").load(paths).select("path", "content")
        return [(r["path"], read_avro(bytes(r["content"]))) for r in raw.toLocalIterator()]

    def manifests(self, snapshot_id: int | None = None) -> list[dict]:
        wanted = snapshot_id or self.current_snapshot_id()
        lists = [s["manifest-list"] for s in self.metadata.get("snapshots", []) if s["snapshot-id"] == wanted]
        return self._avro(lists)[0][1] if lists else []

    def changed_manifests(self, since: int) -> list[dict]:
        return [m for m in self.manifests() if m["added_snapshot_id"] > since]

    def spec(self, spec_id: int) -> list[dict]:
        """The fields of a partition spec."""
        return next((s["fields"] for s in self.metadata.get("partition-specs", []) if s.get("spec-id") == spec_id), [])

    def pruned(self, where: Filter | None, snapshot_id: int | None = None) -> list[dict]:
        """The manifests that may hold a file for the filter: by the summaries of their identity partitions. Those of deletes all stay."""
        kinds = {f["id"]: (f["name"], f["type"]) for f in self.schema(snapshot_id)}

        def may(m: dict) -> bool:
            if m.get("content") == 1:
                return True
            for field, summary in zip(self.spec(m.get("partition_spec_id") or 0), m.get("partitions") or [], strict=False):
                name, kind = kinds.get(field["source-id"], (None, None))
                if field["transform"] == "identity" and isinstance(kind, str):
                    low, high = decode(kind, summary.get("lower_bound")), decode(kind, summary.get("upper_bound"))
                    if not all(possible(f, low, high, summary.get("contains_null", True)) for f in conjuncts(where) if f.column == name):
                        return False
            return True

        return [m for m in self.manifests(snapshot_id) if may(m)]

    def files(self, snapshot_id: int | None = None, where: Filter | None = None) -> DataFrame:
        """Live data and delete files (content 1: by position, 2: by equal values) of the manifests that ``where`` leaves, without data files whose column bounds rule it out; manifests are parsed on the executors.

        A file without a sequence number of its own has its manifest's. ``spec_id`` and ``partition_values`` are its partition.
        """
        manifests = self.pruned(where, snapshot_id)
        kinds = {f["name"]: (f["id"], f["type"]) for f in self.schema(snapshot_id) if isinstance(f["type"], str)}
        asked = [(f, *kinds[f.column]) for f in conjuncts(where) if f.column in kinds]
        schema = "path string, format string, record_count long, size long, partition_values string, content int, snapshot_id long, sequence_number long, equality_ids array<int>, spec_id int"
        if not manifests:
            return self.spark.createDataFrame([], schema)
        sequence = {_plain(m["manifest_path"]): (m.get("sequence_number") or 0, m.get("partition_spec_id") or 0) for m in manifests}

        def ruled_out(f: dict) -> bool:
            bound = lambda side: {e["key"]: e["value"] for e in f.get(side) or []}
            low, high = bound("lower_bounds"), bound("upper_bounds")
            return f.get("content", 0) == 0 and not all(possible(p, decode(kind, low.get(i)), decode(kind, high.get(i))) for p, i, kind in asked)

        def parse(batches):
            import pandas as pd

            for pdf in batches:
                rows = []
                for path, content in zip(pdf["path"], pdf["content"], strict=True):
                    for e in read_avro(bytes(content)):
                        f, number = e["data_file"], e.get("sequence_number")
                        of_manifest, spec_id = sequence[_plain(path)]
                        if e["status"] != 2 and not ruled_out(f):
                            rows.append((f["file_path"], f["file_format"], f["record_count"], f["file_size_in_bytes"], json.dumps(f.get("partition") or {}, default=str), f.get("content", 0), e.get("snapshot_id"), of_manifest if number is None else number, f.get("equality_ids"), spec_id))
                yield pd.DataFrame(rows, columns=["path", "format", "record_count", "size", "partition_values", "content", "snapshot_id", "sequence_number", "equality_ids", "spec_id"])

        return self.spark.read.format("binaryFile").load([m["manifest_path"] for m in manifests]).select("path", "content").mapInPandas(parse, schema)

    def scan(self, snapshot_id: int | None = None, where: Filter | None = None) -> DataFrame:
        """The rows of a snapshot for which ``where`` holds: those of its Parquet data files that no delete file takes away.

        Columns are those of the snapshot's schema, found in each file by their ids, or in files without ids by the table's name mapping. A position delete names a file and a row of it; an equality delete takes rows of files with a smaller sequence number, of its own partition and spec, or of all if it has no partition.
        """
        files, schema = self.files(snapshot_id, where), field_ids.iceberg_schema(self.schema(snapshot_id))
        live = [r.asDict() for r in files.select("path", "content", "sequence_number", "equality_ids").toLocalIterator()]
        paths = [f["path"] for f in live if f["content"] == 0]
        if not paths:
            return self.spark.createDataFrame([], schema)
        mapping = json.loads(self.metadata.get("properties", {}).get("schema.name-mapping.default") or "[]")
        plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
        rows = field_ids.read(self.spark, paths, schema, mapping, places=True)
        rows = rows.select(F.struct(*[F.col(f"`{n}`") for n in schema.names]).alias("row"), plain(F.col("_path")).alias("path"), F.col("_pos").alias("pos"))
        if by_position := [f["path"] for f in live if f["content"] == 1]:
            gone = self.spark.read.parquet(*by_position).select(plain(F.col("file_path")).alias("path"), "pos").distinct()
            rows = rows.join(gone, ["path", "pos"], "left_anti")
        by_value: dict[tuple[int, ...], list[dict]] = {}
        for f in live:
            if f["content"] == 2:
                by_value.setdefault(tuple(sorted(f["equality_ids"] or [])), []).append(f)
        if by_value:
            scope = F.when(F.col("partition_values") != "{}", F.concat_ws("|", "spec_id", "partition_values"))
            numbers = files.filter("content = 0").select(plain(F.col("path")).alias("path"), F.col("sequence_number").alias("written"), scope.alias("part"))
            rows = rows.join(numbers, "path")
            of_id = {f.metadata[field_ids.ID]: f for f in schema.fields}
            deletes = files.filter("content = 2").select(plain(F.col("path")).alias("_path"), F.col("sequence_number").alias("deleted"), scope.alias("scope"))
            for ids, group in by_value.items():
                columns = [of_id[i].name for i in ids]
                gone = field_ids.read(self.spark, [f["path"] for f in group], T.StructType([of_id[i] for i in ids]), mapping, places=True)
                gone = gone.select(*columns, plain(F.col("_path")).alias("_path")).join(deletes, "_path")
                gone = gone.groupBy(*columns, "scope").agg(F.max("deleted").alias("deleted"))  # the last delete of a value is what counts
                gone = gone.select(F.struct(*columns).alias("key"), "deleted", "scope")
                same = [F.col("row")[c].eqNullSafe(F.col("key")[c]) for c in columns]
                rows = rows.join(gone, reduce(lambda a, b: a & b, same) & (F.col("written") < F.col("deleted")) & (F.col("scope").isNull() | (F.col("scope") == F.col("part"))), "left_anti")
        rows = rows.select("row.*")
        return rows if where is None else rows.filter(holds(where))


def _plain(path: str) -> str:
    """file:/x and file:///x are one."""
    return re.sub("^([a-z0-9]+):/+", r"\1:/", path)


def catalog(config: dict):
    """Catalogs need services that are reached over a network: the kinds are checked, and the caller's own client is used."""
    kind = config.get("catalog_type")
    if kind not in ("rest", "glue", "hms"):
        raise ValueError(f"unknown catalog type {kind!r}")
    if "client" not in config:
        raise NotImplementedError(f"give a client for the {kind} catalog under 'client'")
    return config["client"]
