"""Hive-style Parquet tables: partitions, files, schemas and name mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import percent_decode
from .filters import Filter, compile_filter


def _values(path: Column) -> Column:
    pairs = F.regexp_extract_all(path, F.lit(r"([^/=]+=[^/]*)/"), F.lit(1))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    return F.map_from_arrays(keys, F.transform(pairs, lambda p: percent_decode(F.substring_index(p, "=", -1))))


def files(spark: SparkSession, path: str, partition: Filter | None = None) -> DataFrame:
    """``path, size, modification_time, partition_values`` of every Parquet file, contents unread; values stay text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    out = raw.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modification_time"), _values(F.col("path")).alias("partition_values"))
    return out if partition is None else out.filter(compile_filter(partition, F.col("partition_values"), "reader"))


def table_info(spark: SparkSession, path: str) -> dict:
    """Partition columns and schema, as text partitions."""
    listed = files(spark, path)
    keys = listed.select(F.explode(F.map_keys("partition_values")).alias("k")).distinct().collect()
    return {"partition_columns": sorted(r["k"] for r in keys), "schema": read(spark, path).schema}


def read(spark: SparkSession, path: str, infer_partition_types: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", str(infer_partition_types).lower())
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionColumnTypeInference.enabled")


def apply_name_mapping(df: DataFrame, mapping: list[dict]) -> DataFrame:
    """Rename by a mapping of ``{"field-id": .., "names": [aliases..]}``: the first name is the logical one, any alias is found."""
    for entry in mapping:
        logical, *aliases = entry["names"]
        for alias in aliases:
            if alias in df.columns and logical not in df.columns:
                df = df.withColumnRenamed(alias, logical)
    return df


# How the types of files become index types.
INDEX_TYPES = {
    "boolean": "BOOLEAN", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "FLOAT", "double": "FLOAT",
    "string": "TEXT", "binary": "BYTES", "timestamp": "DATE", "timestamp_ntz": "DATE", "date": "DATE", "variant": "JSON",
}


def index_schema(df: DataFrame, ips: frozenset[str] = frozenset(), json: frozenset[str] = frozenset()) -> dict[str, str]:
    """Index type of each column; declared addresses and JSON must be strings, and what has no type is left out."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "string" and name in ips:
            out[name] = "IP_ADDR"
        elif (kind == "string" and name in json) or kind.startswith(("array", "map", "struct")):
            out[name] = "JSON"
        elif kind.startswith("decimal"):
            out[name] = "UNSIGNED" if kind == "decimal(20,0)" else "FLOAT"
        elif kind in INDEX_TYPES:
            out[name] = INDEX_TYPES[kind]
    return out


# The first type seen gives way to the second in these cases.
_WIDER = {"bool": {"date", "u64", "i64", "f64"}, "date": {"u64", "i64", "f64"}, "u64": {"i64", "f64"}, "i64": {"f64"}}


def widen(first: str, second: str) -> str:
    """Type of a dynamic field on which two documents differ."""
    if first == second:
        return first
    return second if first == "text" or second in _WIDER.get(first, ()) else first
