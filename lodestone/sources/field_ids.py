"""Parquet columns matched by field id, at every depth of structs, lists and maps: a renamed, moved or added column reads right.

The wanted schema carries each field's id in its metadata, and Spark's Parquet reader matches by it, also where a file has a column of the same name and
another id. Files without ids (those that were imported) are read by names: of the schema that their footer embeds, else of a name mapping, else of the
wanted schema itself. What a file doesn't have is null. Footers are read on the executors, a row a file; files that are read by names go in groups of equal schemas.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where Spark looks for a field's id.
ID = "parquet.field.id"
# Primitive types of Iceberg schemas.
_PRIMITIVES = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "time": T.LongType(), "string": T.StringType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "binary": T.BinaryType(), "uuid": T.BinaryType(),
}


def iceberg_type(kind) -> T.DataType:
    if isinstance(kind, str):
        if kind.startswith("decimal"):
            precision, scale = kind[kind.index("(") + 1 : -1].split(",")
            return T.DecimalType(int(precision), int(scale))
        return T.BinaryType() if kind.startswith("fixed") else _PRIMITIVES[kind]
    if kind["type"] == "struct":
        return iceberg_schema(kind["fields"])
    if kind["type"] == "list":
        return T.ArrayType(iceberg_type(kind["element"]), not kind.get("element-required", False))
    return T.MapType(iceberg_type(kind["key"]), iceberg_type(kind["value"]), not kind.get("value-required", False))


def iceberg_schema(fields: list[dict]) -> T.StructType:
    """Fields of an Iceberg schema with their ids."""
    return T.StructType([T.StructField(f["name"], iceberg_type(f["type"]), True, {ID: f["id"]}) for f in fields])


def delta_schema(schema: T.DataType, mode: str = "id") -> T.DataType:
    """A Delta schema as its files have it: with ids (mode ``id``) or under the physical names (mode ``name``)."""
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(delta_schema(schema.elementType, mode), schema.containsNull)
    if isinstance(schema, T.MapType):
        return T.MapType(delta_schema(schema.keyType, mode), delta_schema(schema.valueType, mode), schema.valueContainsNull)
    if not isinstance(schema, T.StructType):
        return schema
    out = []
    for f in schema.fields:
        held = {ID: int(f.metadata["delta.columnMapping.id"])} if mode == "id" and "delta.columnMapping.id" in f.metadata else {}
        name = f.metadata.get("delta.columnMapping.physicalName", f.name) if mode == "name" else f.name
        out.append(T.StructField(name, delta_schema(f.dataType, mode), f.nullable, held))
    return T.StructType(out)


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, columns array<name, id>, ids, embedded, shape`` of files: top-level columns, whether any field has an id, the Iceberg schema that the footer embeds, and a text of the file's schema."""

    def read(batches):
        import pandas as pd
        import pyarrow.fs
        import pyarrow.parquet as pq

        def inner(field):
            yield field
            for k in range(field.type.num_fields):
                yield from inner(field.type.field(k))

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                fs, at = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
                with fs.open_input_file(at) as f:
                    schema = pq.ParquetFile(f).schema_arrow
                id_of = lambda field: int(v) if (v := (field.metadata or {}).get(b"PARQUET:field_id")) else None
                columns = [{"name": f.name, "id": id_of(f)} for f in schema]
                ids = any(id_of(g) is not None for f in schema for g in inner(f))
                embedded = (schema.metadata or {}).get(b"iceberg.schema")
                rows.append((path, columns, ids, embedded.decode() if embedded else None, schema.remove_metadata().to_string(show_field_metadata=False)))
            yield pd.DataFrame(rows, columns=["path", "columns", "ids", "embedded", "shape"])

    if not paths:
        return spark.createDataFrame([], "path string, columns array<struct<name:string,id:int>>, ids boolean, embedded string, shape string")
    tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return listed.mapInPandas(read, "path string, columns array<struct<name:string,id:int>>, ids boolean, embedded string, shape string")


def column_mapping(spark: SparkSession, paths: list[str], names: dict[int, str]) -> DataFrame:
    """``path, physical, logical``: the name of each top-level column by its id, or by the id that the embedded schema gives its name; its own name if neither is known."""
    if not names:
        return footers(spark, paths).select("path", F.explode("columns").alias("c")).select("path", F.col("c.name").alias("physical"), F.col("c.name").alias("logical"))
    logical = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    embedded = F.from_json(F.col("embedded"), "struct<fields:array<struct<id:int,name:string>>>")["fields"]
    each = footers(spark, paths).select("path", embedded.alias("_e"), F.explode("columns").alias("c"))
    told = F.get(F.filter("_e", lambda e: e["name"] == F.col("c.name")), F.lit(0))["id"]
    found = F.coalesce(logical[F.col("c.id")], logical[told], F.col("c.name"))
    return each.select("path", F.col("c.name").alias("physical"), found.alias("logical"))


# ---------------------------------------------------------------------- by names
def _children(kind) -> list[dict]:
    """Fields within a type of an Iceberg schema: those of a struct, or the element, or the key and value."""
    if isinstance(kind, str):
        return []
    if kind["type"] == "struct":
        return kind["fields"]
    parts = ("element",) if kind["type"] == "list" else ("key", "value")
    return [{"id": kind.get(f"{p}-id"), "name": p, "type": kind[p]} for p in parts]


def mapping_of(fields: list[dict]) -> list[dict]:
    """The name mapping that an Iceberg schema is."""
    return [{"field-id": f.get("id"), "names": [f["name"]], "fields": mapping_of(_children(f["type"]))} for f in fields]


def _within(mapping: list[dict], part: str) -> list[dict]:
    return next((m.get("fields") or [] for m in mapping if part in m.get("names", [])), [])


def _built(value: Column, have: T.DataType, want: T.DataType, mapping: list[dict]) -> Column:
    """A value of a file in the wanted type; names of its parts are looked up in the mapping."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        parts = [_field(lambda n: value[n], have, f, mapping).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*parts)).otherwise(F.lit(None).cast(want))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: _built(x, have.elementType, want.elementType, _within(mapping, "element")))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        keyed = lambda e: F.struct(_built(e["key"], have.keyType, want.keyType, _within(mapping, "key")), _built(e["value"], have.valueType, want.valueType, _within(mapping, "value")))
        return F.map_from_entries(F.transform(F.map_entries(value), keyed))
    return value.cast(want)


def _field(get, have: T.StructType, want: T.StructField, mapping: list[dict]) -> Column:
    entry = next((m for m in mapping if m.get("field-id") is not None and m.get("field-id") == want.metadata.get(ID)), None)
    names = entry["names"] if entry else [] if mapping else [want.name]  # a mapping that doesn't know a field says that files lack it
    name = next((n for n in names if n in have.fieldNames()), None)
    if name is None:
        return F.lit(None).cast(want.dataType)
    return _built(get(name), have[name].dataType, want.dataType, (entry or {}).get("fields") or [])


def _by_id(kind: T.DataType) -> T.DataType:
    """The type with each field that has an id under a name made of it: the reader takes types by name where a file reuses the name of a field for another."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f"_id_{f.metadata[ID]}" if ID in f.metadata else f.name, _by_id(f.dataType), f.nullable, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_by_id(kind.elementType), kind.containsNull)
    return T.MapType(_by_id(kind.keyType), _by_id(kind.valueType), kind.valueContainsNull) if isinstance(kind, T.MapType) else kind


def read(spark: SparkSession, paths: list[str], schema: T.StructType, mapping: list[dict] | None = None, places: bool = False) -> DataFrame:
    """The rows of Parquet files in ``schema``, whose fields carry their ids; with ``places`` also ``_path`` and ``_pos`` of each row.

    The session's reader is set to match by ids from now on, which changes nothing for schemas without ids.
    """
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_pos")] if places else []
    whole = T.StructType([*schema.fields, *([T.StructField("_path", T.StringType()), T.StructField("_pos", T.LongType())] if places else [])])
    by_ids, groups = [], {}
    for r in footers(spark, paths).select("path", "ids", "embedded", "shape").collect():  # as long as the list of paths
        if r["ids"]:
            by_ids.append(r["path"])
        else:
            groups.setdefault((r["embedded"], r["shape"]), []).append(r["path"])
    named = _by_id(schema)
    back = [F.col(f"`{a.name}`").cast(b.dataType).alias(b.name) for a, b in zip(named.fields, schema.fields, strict=True)]  # the same types under their own names
    frames = [spark.read.schema(named).parquet(*by_ids).select(*back, *place)] if by_ids else []
    for (embedded, _), members in groups.items():
        raw = spark.read.parquet(*members)
        names = mapping_of(json.loads(embedded)["fields"]) if embedded else mapping or []
        frames.append(raw.select(*[_field(lambda n: F.col(f"`{n}`"), raw.schema, f, names).alias(f.name) for f in schema.fields], *place))  # noqa: B023
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], whole)
