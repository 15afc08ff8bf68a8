"""Delta tables read from their logs: checkpoint Parquet and JSON commits, replayed as a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import Filter, compile_filter

_ADD = "struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,dataChange:boolean,stats:string,deletionVector:struct<storageType:string>>"
_REMOVE = "struct<path:string,deletionTimestamp:bigint,dataChange:boolean>"
_META = "struct<id:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>"
SCHEMA = f"add {_ADD}, remove {_REMOVE}, metaData {_META}"


class DeltaTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.log = spark, f"{path.rstrip('/')}/_delta_log"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.log)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(at))
        self.commits = [int(n[:20]) for n in names if re.fullmatch(r"\d{20}\.json", n)]
        found: dict[int, dict[int, dict[int, str]]] = {}
        for n in names:
            if m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet", n):
                found.setdefault(int(m[1]), {}).setdefault(int(m[3] or 1), {})[int(m[2] or 1)] = n
        # a checkpoint counts when all of its parts are there
        self._parts: dict[int, list[str]] = {}
        for version, ways in found.items():
            whole = [[parts[k] for k in sorted(parts)] for n, parts in sorted(ways.items()) if len(parts) == n]
            if whole:
                self._parts[version] = whole[0]

    def current_version(self) -> int:
        return max([*self.commits, *self._parts])

    def checkpoint_version(self, up_to: int | None = None) -> int | None:
        found = [v for v in self._parts if up_to is None or v <= up_to]
        return max(found) if found else None

    def snapshot_info(self) -> dict:
        base = self.checkpoint_version()
        later = [v for v in self.commits if base is None or v > base]
        return {"checkpoint_version": base, "checkpoint_parts": self.checkpoint_parts(base), "commits": [f"{self.log}/{v:020d}.json" for v in later], "later_commits": len(later)}

    def checkpoint_parts(self, version: int | None) -> list[str]:
        return [f"{self.log}/{n}" for n in self._parts.get(version, [])] if version is not None else []

    def read_checkpoint(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*parts).withColumn("version", F.lit(-1).cast("long"))

    def read_commits(self, versions: list[int]) -> DataFrame:
        raw = self.spark.read.schema(SCHEMA).json([f"{self.log}/{v:020d}.json" for v in versions])
        return raw.withColumn("version", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{20})", 1).cast("long"))

    def _actions(self, version: int | None) -> DataFrame:
        base = self.checkpoint_version(version)
        commits = [v for v in self.commits if (base is None or v > base) and (version is None or v <= version)]
        frames = ([self.read_checkpoint(self.checkpoint_parts(base))] if base is not None else []) + ([self.read_commits(commits)] if commits else [])
        if not frames:
            raise ValueError(f"no version {version}")
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def files(self, version: int | None = None, partition: Filter | None = None) -> DataFrame:
        """``path, size, modification_time, num_records, partition_values, has_deletion_vector`` of the live files."""
        a = self._actions(version)
        each = a.filter("add is not null or remove is not null").select("version", F.coalesce("add.path", "remove.path").alias("path"), "add")
        latest = Window.partitionBy("path").orderBy(F.desc("version"), F.col("add").isNull().asc())
        live = each.withColumn("_r", F.row_number().over(latest)).filter("_r = 1 and add is not null")
        out = live.select(
            "path", F.col("add.size").alias("size"), F.col("add.modificationTime").alias("modification_time"), F.get_json_object("add.stats", "$.numRecords").cast("long").alias("num_records"),
            F.col("add.partitionValues").alias("partition_values"), F.col("add.deletionVector").isNotNull().alias("has_deletion_vector"),
        )
        return out if partition is None else out.filter(compile_filter(partition, F.col("partition_values"), "reader"))

    def changes(self, from_version: int, to_version: int) -> DataFrame:
        """Adds and removes of versions in (from, to]."""
        versions = [v for v in self.commits if from_version < v <= to_version]
        if not versions:
            return self.spark.createDataFrame([], "version long, path string, change string")
        a = self.read_commits(versions).filter("add is not null or remove is not null")
        return a.select("version", F.coalesce("add.path", "remove.path").alias("path"), F.when(F.col("add").isNotNull(), "add").otherwise("remove").alias("change"))

    def metadata(self, version: int | None = None) -> dict:
        row = self._actions(version).filter("metaData is not null").orderBy(F.desc("version")).select("metaData.*").first()
        return row.asDict() if row else {}

    def schema(self, version: int | None = None) -> T.StructType:
        import json

        return T.StructType.fromJson(json.loads(self.metadata(version)["schemaString"]))

    def column_mapping(self) -> dict[str, str]:
        """Physical to logical names."""
        return {f.metadata.get("delta.columnMapping.physicalName", f.name): f.name for f in self.schema().fields}
