"""The stored state of a log: manifests of file entries, an index of their bounds, and tombstones beside them.

A manifest is one Parquet file of at most MANIFEST_ENTRIES live files, written once and shared by all later states. A state is a small folder: ``manifests`` (a row for each
manifest: entries, versions, bounds of the partition values), ``removed`` (tombstones: entries of that path and of a version below ``before`` are dead) and ``rest`` (protocol, metadata, skips).
The next state is made from the last one and the versions since: new files go to new manifests, removes become tombstones, and nothing old is written again, until

* tombstones exceed a tenth of the entries: the manifests that hold dead entries, and only these, are written anew without them;
* more than MANY manifests are less than half full: these are written anew as full ones.

A reader compares its filter with the index, opens the manifests that are left, takes the tombstones away and adds the versions since. So a listing costs what it asks for, not what the table holds;
what reaches the driver is the names of the manifests that are opened.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import Filter

# The least sizes at which states are divided and compacted.
MANIFEST_ENTRIES, MANY, DEAD_SHARE = 50_000, 20, 0.1
_BOUND = "struct<lo: string, hi: string, nlo: double, nhi: double, odd: long, nulls: long>"
INDEX_SCHEMA = f"path string, entries long, first_version long, last_version long, bytes long, bounds map<string, {_BOUND}>"


# ---------------------------------------------------------------------- bounds
def may_hold(f: Filter, bounds: Column) -> Column:
    """Whether a manifest of these bounds may hold an entry for the filter, in the log's numeric-aware dialect; false only where none can be."""
    if f.op in ("and", "or"):
        return reduce((lambda a, b: a & b) if f.op == "and" else (lambda a, b: a | b), [may_hold(p, bounds) for p in f.parts])
    b = F.try_element_at(bounds, F.lit(f.column))
    if f.op in ("eq", "in"):
        values = [str(v) for v in (f.value if f.op == "in" else [f.value])]  # type: ignore[union-attr]
        out = reduce(lambda x, y: x | y, [(b["lo"] <= v) & (b["hi"] >= v) for v in values], F.lit(False))
    elif f.op in ("gt", "gte", "lt", "lte"):
        value = F.lit(str(f.value))
        number, up = value.try_cast("double"), f.op in ("gt", "gte")
        texts = b["hi"] >= value if up else b["lo"] <= value
        numbers = (b["nhi"] >= number if up else b["nlo"] <= number) | (b["odd"] > 0)
        out = F.when(number.isNotNull(), numbers).otherwise(texts)
    elif f.op == "starts_with":
        out = (b["hi"] >= str(f.value)) & (F.substring(b["lo"], 1, len(str(f.value))) <= str(f.value))
    elif f.op == "is_null":
        out = b["nulls"] > 0
    else:  # negations and searches inside a text skip nothing
        return F.lit(True)
    return F.coalesce(out, F.lit(True))


def index_of(spark: SparkSession, root: str, folder: str, schema: str) -> DataFrame:
    """The index rows of the manifests in a folder."""
    rows = spark.read.schema(schema).parquet(f"{root}/{folder}").select(
        F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("manifest"), "version", "size", F.explode_outer("partitionValues").alias("name", "value")
    )
    # an entry has a row for each of its partition columns; the counts are those of its commonest column
    number = F.col("value").try_cast("double")
    text = F.when(F.col("value") != "", F.col("value"))
    named = rows.groupBy("manifest", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("version").alias("v0"), F.max("version").alias("v1"), F.sum("size").alias("bytes"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min(number).alias("nlo"), F.max(number).alias("nhi"), F.count_if(F.col("value").isNotNull() & number.isNull()).alias("odd"), F.count(text).alias("there"),
    )
    whole = Window.partitionBy("manifest")  # a row for each partition column of one manifest
    named = named.withColumn("entries", F.max("n").over(whole))
    bound = F.struct("lo", "hi", "nlo", "nhi", "odd", (F.col("entries") - F.col("there")).alias("nulls"))
    entry = F.map_from_entries(F.filter(F.collect_list(F.struct("name", bound.alias("b"))), lambda e: e["name"].isNotNull()))
    out = named.groupBy("manifest").agg(F.max("entries").alias("entries"), F.min("v0").alias("first_version"), F.max("v1").alias("last_version"), F.max("bytes").alias("bytes"), entry.cast(f"map<string, {_BOUND}>").alias("bounds"))
    return out.withColumnRenamed("manifest", "path")


def write_manifests(entries: DataFrame, to: str, most: int) -> int:
    """Entries as manifests of at most ``most`` rows, those of a partition side by side; how many rows."""
    n = entries.count()
    if n:
        keyed = entries.withColumn("_p", F.coalesce(F.to_json("partitionValues"), F.lit("")))
        dealt = keyed.repartitionByRange(-(-n // most), "_p", "path").sortWithinPartitions("_p", "path")
        dealt.drop("_p").write.option("maxRecordsPerFile", most).parquet(to)
    return n


# ---------------------------------------------------------------------- replay of what is new
def net(actions: DataFrame) -> DataFrame:
    """The last add or remove of each path."""
    latest = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("seq"))
    return actions.filter(F.col("action").isin("add", "remove")).withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")


def living(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries that no tombstone has killed."""
    dead = removed.select(F.col("path").alias("_gone"), "before")
    return entries.join(dead, (entries["path"] == F.col("_gone")) & (entries["version"] < F.col("before")), "left_anti")


@dataclass
class Listing:
    """Files of a listing, and what it took: manifests there are, those opened; ``counts()`` runs the stages' counts."""

    files: DataFrame
    manifests: int
    opened: list[str]
    stages: list[tuple[str, DataFrame]] = field(default_factory=list)

    def counts(self) -> dict[str, int]:
        out = {"manifests": self.manifests, "manifests_opened": len(self.opened)}
        return out | {name: df.count() for name, df in self.stages}


class State:
    """A published state on disk."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str) -> None:
        self.spark, self.root, self.name, self.schema = spark, root, name, schema

    def manifests(self) -> DataFrame:
        return self.spark.read.schema(INDEX_SCHEMA).parquet(f"{self.root}/{self.name}/manifests")

    def removed(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, before long, applied boolean").parquet(f"{self.root}/{self.name}/removed")

    def rest(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self.name}/rest")

    def pruned(self, partition: Filter | None = None, from_version: int | None = None, to_version: int | None = None) -> list[str]:
        """Names of the manifests that may hold an entry for the filter, of versions in (from, to]."""
        out = self.manifests()
        if partition is not None:
            out = out.filter(may_hold(partition, F.col("bounds")))
        if from_version is not None:
            out = out.filter(F.col("last_version") > from_version)
        if to_version is not None:
            out = out.filter(F.col("first_version") <= to_version)
        return [r["path"] for r in out.select("path").orderBy("path").collect()]  # one for up to MANIFEST_ENTRIES files

    def entries(self, manifests: list[str] | None = None) -> DataFrame:
        """The living entries of the named manifests, by default of all."""
        return living(self.stored(self.pruned() if manifests is None else manifests), self.removed().filter("not applied"))

    def stored(self, manifests: list[str]) -> DataFrame:
        if not manifests:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{m}" for m in manifests])

    def actions(self) -> DataFrame:
        """All of the state as actions."""
        return self.entries().unionByName(self.removed().select(self.stored([]).columns).filter("action = 'remove'")).unionByName(self.rest())


def write_state(spark: SparkSession, root: str, name: str, schema: str, last: State | None, since: DataFrame, version: int, keep_removed_since: int | None = None, most: int = MANIFEST_ENTRIES) -> dict:
    """Write the state that follows ``last`` (or the first one) after the actions ``since``; its numbers."""
    changed = net(since).cache()
    try:
        new, folder = changed.filter("action = 'add'"), f"manifest-{name.removeprefix('state-')}"
        index, dead = spark.createDataFrame([], INDEX_SCHEMA), []
        gone = changed.filter("action = 'remove'").withColumns({"before": F.col("version") + 1, "applied": F.lit(last is None)})
        rest = since
        if last is not None:
            index, rest = last.manifests(), last.rest().unionByName(since)
            known = last.stored(last.pruned()).select("path").distinct()
            again = new.join(known, "path", "left_semi").select(*new.columns).withColumns({"action": F.lit("replace"), "before": F.col("version"), "applied": F.lit(False)})
            newest = Window.partitionBy("path").orderBy(F.desc("before"))
            gone = last.removed().unionByName(gone).unionByName(again).withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
            gone, dead = _compacted(last, gone, most)
            if dead:
                index = index.filter(~F.col("path").isin(dead))
                new = new.unionByName(living(last.stored(dead), gone.filter("not applied")).select(new.columns))
                untouched = [m for m in last.pruned() if m not in set(dead)]
                still = last.stored(untouched).join(gone.filter("not applied").select(F.col("path").alias("_g"), "before"), (F.col("path") == F.col("_g")) & (F.col("version") < F.col("before")), "left_semi").select("path").distinct()
                gone = gone.join(still.withColumn("_still", F.lit(True)), "path", "left").withColumn("applied", F.col("applied") | F.col("_still").isNull()).select(gone.columns)
        if keep_removed_since is not None:
            kept = ~F.col("applied") | ((F.col("action") == "remove") & (F.col("deletionTimestamp") >= keep_removed_since))
        else:
            kept = ~F.col("applied")
        if write_manifests(new, f"{root}/{folder}", most):
            index = index.unionByName(index_of(spark, root, folder, schema))
        at = f"{root}/{name}"
        index.coalesce(1).write.parquet(f"{at}/manifests")
        gone.filter(kept).repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{at}/removed")  # a reader of some paths opens their row groups
        singles = [rest.filter(F.col("action") == a).orderBy(F.desc("version"), F.desc("seq")).limit(1) for a in ("protocol", "metaData")]
        reduce(DataFrame.unionByName, [*singles, rest.filter("action = 'mergeskip'")]).coalesce(1).write.parquet(f"{at}/rest")
        numbers = spark.read.schema(INDEX_SCHEMA).parquet(f"{at}/manifests").agg(F.count(F.lit(1)).alias("manifests"), F.sum("entries").alias("entries")).first()
        return {"version": version, "path": name, "manifests": numbers["manifests"], "entries": numbers["entries"] or 0, "rewritten": len(dead)}
    finally:
        changed.unpersist()


def _compacted(last: State, gone: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """Which manifests to write anew: those with dead entries if too many are dead, and the small ones if there are too many of them."""
    total = last.manifests().agg(F.sum("entries").alias("n"), F.count_if(F.col("entries") * 2 < most).alias("small")).first()
    waiting = gone.filter("not applied")
    out: set[str] = set()
    if waiting.count() > DEAD_SHARE * (total["n"] or 0):
        held = last.stored(last.pruned()).select("path", "version", F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name")).alias("manifest"))
        dead = waiting.select(F.col("path").alias("_gone"), "before")
        hit = held.join(dead, (F.col("path") == F.col("_gone")) & (F.col("version") < F.col("before"))).select("manifest").distinct()
        out |= {r["manifest"] for r in hit.collect()}  # at most one for each manifest
    if total["small"] > MANY:
        out |= {r["path"] for r in last.manifests().filter(F.col("entries") * 2 < most).select("path").collect()}
    return gone, sorted(out)
