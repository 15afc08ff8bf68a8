"""Columns by field id: renames, reused names and added fields at every depth; files without ids by names."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from lodestone.sources import field_ids, iceberg

from .test_engine import avro, record


def ident(name, kind, k):
    return pa.field(name, kind, metadata={"PARQUET:field_id": str(k)} if k else None)


def old_schema(ids=True):
    """The schema before the renames: names a, s.x, l.element.y, m.value.z."""
    n = (lambda k: k) if ids else (lambda k: None)
    inner = pa.struct([ident("y", pa.string(), n(6))])
    return pa.schema([
        ident("a", pa.int64(), n(1)), ident("b", pa.string(), n(2)), ident("s", pa.struct([ident("x", pa.int32(), n(4))]), n(3)), ident("l", pa.list_(ident("element", inner, n(9))), n(5)),
        ident("m", pa.map_(ident("key", pa.string(), n(10)).with_nullable(False), ident("value", pa.struct([ident("z", pa.int64(), n(8))]), n(11))), n(7)),
    ])


OLD = [{"a": 1, "b": "one", "s": {"x": 10}, "l": [{"y": "p"}, {"y": None}], "m": [("k", {"z": 5})]}, {"a": None, "b": None, "s": None, "l": [], "m": None}]
# the table now: a is called b, b is called a, and what was x, y and z has other names; w is new
FIELDS = [
    {"id": 1, "name": "b", "type": "long"}, {"id": 2, "name": "a", "type": "string"},
    {"id": 3, "name": "group", "type": {"type": "struct", "fields": [{"id": 12, "name": "w", "type": "double"}, {"id": 4, "name": "ex", "type": "int"}]}},
    {"id": 5, "name": "l", "type": {"type": "list", "element-id": 9, "element": {"type": "struct", "fields": [{"id": 6, "name": "why", "type": "string"}]}}},
    {"id": 7, "name": "m", "type": {"type": "map", "key-id": 10, "key": "string", "value-id": 11, "value": {"type": "struct", "fields": [{"id": 8, "name": "zed", "type": "long"}]}}},
    {"id": 13, "name": "s", "type": "decimal(9,2)"},
]
WANT = [(1, "one", (None, 10), [("p",), (None,)], {"k": (5,)}, None), (None, None, None, [], None, None)]
MAPPING = [
    {"field-id": 1, "names": ["b0", "a"]}, {"field-id": 2, "names": ["b"]}, {"field-id": 3, "names": ["s"], "fields": [{"field-id": 4, "names": ["ex", "x"]}]},
    {"field-id": 5, "names": ["l"], "fields": [{"field-id": 9, "names": ["element"], "fields": [{"field-id": 6, "names": ["y"]}]}]},
    {"field-id": 7, "names": ["m"], "fields": [{"field-id": 11, "names": ["value"], "fields": [{"field-id": 8, "names": ["z"]}]}]},
]


def write(path, schema, rows, embedded=None):
    table = pa.Table.from_pylist(rows, schema)
    pq.write_table(table.replace_schema_metadata({"iceberg.schema": json.dumps(embedded)}) if embedded else table, path)
    return f"file://{path}"


def plain(v):
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else tuple(plain(x) for x in v) if isinstance(v, tuple) else v


def rows(df):
    return sorted((plain(tuple(r)) for r in df.collect()), key=lambda r: r[0] is None)


def test_by_ids_and_by_names(spark, tmp_path):
    schema = field_ids.iceberg_schema(FIELDS)
    by_id = write(tmp_path / "ids.parquet", old_schema(), OLD)
    bare = write(tmp_path / "bare.parquet", old_schema(ids=False), OLD)
    embedded = {"fields": [{"id": 1, "name": "a", "type": "long"}, {"id": 2, "name": "b", "type": "string"}]}
    told = write(tmp_path / "told.parquet", old_schema(ids=False), OLD, embedded)
    assert rows(field_ids.read(spark, [by_id], schema)) == WANT
    assert rows(field_ids.read(spark, [bare], schema, MAPPING)) == WANT
    assert [r[:2] for r in rows(field_ids.read(spark, [told], schema))] == [(1, "one"), (None, None)]
    both = field_ids.read(spark, [by_id, bare], schema, MAPPING, places=True)
    assert both.count() == 4 and {(r["_path"].rsplit("/", 1)[1], r["_pos"]) for r in both.collect()} == {(n, k) for n in ("ids.parquet", "bare.parquet") for k in (0, 1)}
    assert both.filter("b = 1").count() == 2 and both.filter("a = 'one' and group.ex = 10").count() == 2
    own = field_ids.read(spark, [bare], T.StructType([T.StructField("a", T.LongType()), T.StructField("more", T.StringType())]))
    assert rows(own) == [(1, None), (None, None)]
    assert field_ids.read(spark, [], schema, places=True).columns[-2:] == ["_path", "_pos"]
    assert "ReadSchema: struct<_id_1:bigint>" in field_ids.read(spark, [by_id], schema).select("b")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_column_mapping(spark, tmp_path):
    by_id = write(tmp_path / "ids.parquet", old_schema(), OLD)
    told = write(tmp_path / "told.parquet", old_schema(ids=False), OLD, {"fields": [{"id": 2, "name": "b"}]})
    bare = write(tmp_path / "bare.parquet", old_schema(ids=False), OLD)
    got = {}
    for r in field_ids.column_mapping(spark, [by_id, told, bare], {1: "first", 2: "second", 99: "none"}).collect():
        got.setdefault(r["path"], {})[r["physical"]] = r["logical"]
    rest = {c: c for c in "slm"}
    assert got == {by_id: {"a": "first", "b": "second"} | rest, told: {"a": "a", "b": "second"} | rest, bare: {"a": "a", "b": "b"} | rest}
    assert field_ids.column_mapping(spark, [bare], {}).count() == 5


@pytest.mark.parametrize("mode", ["id", "name"])
def test_delta_schema(spark, tmp_path, mode):
    meta = lambda k, p: {"delta.columnMapping.id": k, "delta.columnMapping.physicalName": p}
    logical = T.StructType([T.StructField("total", T.LongType(), True, meta(1, "a")), T.StructField("inner", T.StructType([T.StructField("part", T.IntegerType(), True, meta(4, "x"))]), True, meta(3, "s"))])
    path = write(tmp_path / "d.parquet", old_schema(ids=mode == "id"), OLD)
    held = field_ids.delta_schema(logical, mode)
    df = field_ids.read(spark, [path], held) if mode == "id" else spark.read.schema(held).parquet(path).to(held)
    assert rows(df) == [(1, (10,)), (None, None)]
    assert held.names == (["total", "inner"] if mode == "id" else ["a", "s"])


def test_iceberg_scan_after_renames(spark, tmp_path):
    """A file from before the renames, an imported one without ids, and an equality delete under the old name."""
    first, bare = write(tmp_path / "a.parquet", old_schema(), OLD), write(tmp_path / "b.parquet", old_schema(ids=False), [OLD[0] | {"a": 7, "b": "seven"}])
    gone = write(tmp_path / "d.parquet", pa.schema([ident("a", pa.int64(), 1)]), [{"a": 7}])
    file_kind = record("data_file", content="int", file_path="string", file_format="string", record_count="long", file_size_in_bytes="long", equality_ids=["null", {"type": "array", "items": "int"}])
    entry_kind = record("manifest_entry", status="int", snapshot_id=["null", "long"], sequence_number=["null", "long"], data_file=file_kind)
    list_kind = record("manifest_file", manifest_path="string", sequence_number="long", added_snapshot_id="long", content="int")
    entry = lambda path, content, ids: {"status": 1, "snapshot_id": 1, "sequence_number": None, "data_file": {"content": content, "file_path": path, "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1, "equality_ids": ids}}
    for name, number, entries in (("m1", 1, [entry(first, 0, None), entry(bare, 0, None)]), ("m2", 2, [entry(gone, 2, [1])])):
        (tmp_path / f"{name}.avro").write_bytes(avro(entry_kind, entries))
    listed = lambda *names: [{"manifest_path": f"file://{tmp_path}/{n}.avro", "sequence_number": k, "added_snapshot_id": k, "content": k - 1} for n, k in names]
    for k, manifests in ((1, listed(("m1", 1))), (2, listed(("m1", 1), ("m2", 2))), (3, [])):
        (tmp_path / f"l{k}.avro").write_bytes(avro(list_kind, manifests))
    (tmp_path / "v.json").write_text(json.dumps({
        "current-snapshot-id": 2, "schemas": [{"schema-id": 0, "fields": FIELDS}], "current-schema-id": 0, "properties": {"schema.name-mapping.default": json.dumps(MAPPING)},
        "snapshots": [{"snapshot-id": k, "timestamp-ms": k, "manifest-list": f"file://{tmp_path}/l{k}.avro", "schema-id": 0} for k in (1, 2, 3)],
    }))
    table = iceberg.IcebergTable(spark, f"file://{tmp_path}/v.json")
    assert rows(table.scan()) == WANT
    assert sorted(r["b"] for r in table.scan(1).filter("b is not null").collect()) == [1, 7] and {r["ex"] for r in table.scan(1).select("group.ex").collect()} == {10, None}
    assert table.scan(3).count() == 0 and table.scan(3).columns == [f["name"] for f in FIELDS]
