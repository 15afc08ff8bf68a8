"""The file log of a table: versions of actions as JSON lines, replayed by a DataFrame plan.

``_log/00000000000000000007.json`` is version 7, a line an action; ``_log/state-7-<id>`` is the state at version 7 (manifests shared with other states,
see :mod:`.state`), and ``_log/_last-7.json`` publishes it: a checkpoint that no such file names does not exist for readers, so one that is still
being written, or whose writer died, does no harm. A version's file is written aside and renamed to its number, which fails if
the number is taken; the writer then looks at what came between and tries the next. So a version is whole or absent, and what belongs together is one version.
A version that removes files is only written while all of them are live: if another writer has taken one away, or changed the table's schema, the
commit is refused with :class:`Conflict` and the rewrite is done again on what is there now. Appends never conflict.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import percent_decode
from .filters import Filter, bounds_of, compile_filter, may_match
from .state import MANIFEST_ENTRIES, Listing, State, net, write_state
from .tiers import Tiers

PROTOCOL = 4
_BATCH = "log_batch"  # the outermost partition: the files of one append
ACTION_SCHEMA = (
    "version long, seq int, action string, path string, partitionValues map<string,string>, size long, modificationTime long, dataChange boolean, "
    "numRecords long, minValues map<string,string>, maxValues map<string,string>, deletionTimestamp long, skipTimestamp long, reason string, operation string, "
    "retryAfter long, skipCount int, docMappingRef string, docMapping string, schemaString string, protocolVersion int"
)


class Conflict(RuntimeError):
    """Another writer has removed a file that this commit removes too, or changed the table's schema."""


# ---------------------------------------------------------------------- replay
def replay(actions: DataFrame) -> DataFrame:
    """Live files: the latest add or remove of each path wins, and a remove takes the path away. Skips play no part."""
    latest = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("seq"))
    files = actions.filter(F.col("action").isin("add", "remove")).withColumn("_r", F.row_number().over(latest))
    return files.filter("_r = 1 and action = 'add'").drop("_r")


def last_of(actions: DataFrame, action: str) -> DataFrame:
    """The action in force: the last one."""
    return actions.filter(F.col("action") == action).orderBy(F.desc("version"), F.desc("seq")).limit(1)


def cooling_down(actions: DataFrame, now: int) -> DataFrame:
    """Paths whose last skip asks to wait still."""
    skips = actions.filter("action = 'mergeskip'").groupBy("path").agg(F.max_by("retryAfter", F.struct("version", "seq")).alias("retryAfter"))
    return skips.filter(F.col("retryAfter") > now).select("path")


def list_files(
    actions: DataFrame, partition: Filter | None = None, data: Filter | None = None, kinds: dict[str, str] | None = None, exclude_cooling_at: int | None = None
) -> DataFrame:
    """Live files that the filters leave."""
    out = replay(actions)
    if partition is not None:
        out = out.filter(compile_filter(partition, F.col("partitionValues"), "log"))
    if data is not None:
        out = out.filter(may_match(data, F.col("minValues"), F.col("maxValues"), kinds))
    if exclude_cooling_at is not None:
        out = out.join(cooling_down(actions, exclude_cooling_at), "path", "left_anti")
    return out


def changes(actions: DataFrame, from_version: int, to_version: int) -> DataFrame:
    """Adds and removes of versions in (from, to]; an add that is removed in the same span does not show."""
    span = actions.filter((F.col("version") > from_version) & (F.col("version") <= to_version) & F.col("action").isin("add", "remove"))
    latest = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("seq"))
    first = Window.partitionBy("path").orderBy("version", "seq")
    marked = span.withColumns({"_r": F.row_number().over(latest), "_began": F.first("action").over(first)})
    return marked.filter("_r = 1 and not (action = 'remove' and _began = 'add')").drop("_r", "_began")


def retained_versions(versions: DataFrame, checkpoint: int | None, older_than: int) -> DataFrame:
    """Rows of ``version, time`` to keep: all without a checkpoint, what a reader of the checkpoint needs, and what is young or of unknown age."""
    if checkpoint is None:
        return versions
    return versions.filter((F.col("version") >= checkpoint) | F.col("time").isNull() | (F.col("time") >= older_than))


def dedup_schemas(actions: DataFrame) -> DataFrame:
    """Document mappings replaced by the hash of their text, on all but the metadata rows that define them."""
    return actions.withColumn("docMappingRef", F.coalesce("docMappingRef", F.sha2("docMapping", 256))).withColumn("docMapping", F.lit(None).cast("string"))


def restore_schemas(actions: DataFrame, mappings: DataFrame) -> DataFrame:
    """The inverse, from ``ref, mapping``."""
    found = mappings.select(F.col("ref").alias("docMappingRef"), F.col("mapping"))
    return actions.join(found, "docMappingRef", "left").withColumn("docMapping", F.coalesce("docMapping", "mapping")).drop("mapping")


def tombstones(actions: DataFrame) -> DataFrame:
    """The remove in force of each path that is gone."""
    latest = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("seq"))
    files = actions.filter(F.col("action").isin("add", "remove")).withColumn("_r", F.row_number().over(latest))
    return files.filter("_r = 1 and action = 'remove'").drop("_r")


def garbage(actions: DataFrame, files: DataFrame, removed_before: int) -> DataFrame:
    """Paths of ``files (path, time)`` to delete: removed before that time, or never committed and older than it."""
    plain = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path")  # file:/x and file:///x are one
    files = files.select(plain, "time")
    old = tombstones(actions).filter(F.coalesce("deletionTimestamp", F.lit(0)) < removed_before).select(plain)
    known = actions.filter(F.col("action").isin("add", "remove")).select(plain).distinct()
    stray = files.filter(F.col("time") < removed_before).select("path").join(known, "path", "left_anti")
    return files.select("path").join(old, "path", "left_semi").unionByName(stray)


def manifest(actions: DataFrame, rows_per_group: int = 10_000) -> DataFrame:
    """Live files in groups by their partition values, with each group's bounds: ``group, first_version, last_version, low, high, files``.

    A reader compares a filter with the bounds first and opens the groups that are left; a group holds about ``rows_per_group`` files.
    """
    live = replay(actions)
    keyed = live.withColumn("_p", F.coalesce(F.to_json("partitionValues"), F.lit("")))
    pairs = keyed.select("path", "version", "_p", F.explode_outer("partitionValues").alias("name", "value"))
    groups = keyed.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / rows_per_group).alias("_n"))
    dealt = pairs.join(groups, "_p").withColumn("group", F.concat_ws("#", F.xxhash64("_p").cast("string"), F.pmod(F.xxhash64("path"), F.col("_n")).cast("string")))
    named = dealt.groupBy("group", "name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("version").alias("v0"), F.max("version").alias("v1"), F.count_distinct("path").alias("k"))
    entry = lambda c: F.map_from_entries(F.filter(F.collect_list(F.struct("name", c)), lambda e: e["name"].isNotNull()))
    return named.groupBy("group").agg(F.min("v0").alias("first_version"), F.max("v1").alias("last_version"), entry("lo").alias("low"), entry("hi").alias("high"), F.max("k").alias("files"))


def prune_manifest(groups: DataFrame, partition: Filter | None = None, from_version: int | None = None, to_version: int | None = None) -> DataFrame:
    """Groups that may hold a file for the filter, or of versions in (from, to]."""
    out = groups
    if partition is not None:
        out = out.filter(may_match(partition, F.col("low"), F.col("high")))
    if from_version is not None:
        out = out.filter(F.col("last_version") > from_version)
    return out if to_version is None else out.filter(F.col("first_version") <= to_version)


def _path_of_file() -> Column:
    """The file of a row, as a path: Spark gives it percent-encoded."""
    return percent_decode(F.col("_metadata.file_path"))


# ---------------------------------------------------------------------- the log on a file system
class TransactionLog:
    def __init__(self, spark: SparkSession, table: str) -> None:
        self.spark, self.root, self.data = spark, f"{table.rstrip('/')}/_log", f"{table.rstrip('/')}/data"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, version: int) -> str:
        return f"{self.root}/{version:020d}.json"

    def _listing(self) -> list[tuple[str, int]]:
        at = self._path(self.root)
        if not self._fs.exists(at):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(at)]

    def versions(self) -> list[int]:
        return sorted(int(n[:20]) for n, _ in self._listing() if n.endswith(".json") and n[:20].isdigit())

    def current_version(self) -> int:
        base = self.checkpoint_version()
        return max([*self.versions(), base if base is not None else -1])

    def _published(self) -> list[int]:
        return sorted(int(n[len("_last-") : -len(".json")]) for n, _ in self._listing() if n.startswith("_last-") and n.endswith(".json"))

    def checkpoint_version(self, up_to: int | None = None) -> int | None:
        found = [v for v in self._published() if up_to is None or v <= up_to]
        return max(found) if found else None

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def published(self, up_to: int | None = None) -> dict | None:
        """The last published state: its version, folder and numbers."""
        base = self.checkpoint_version(up_to)
        return None if base is None else json.loads(self._text(f"{self.root}/_last-{base}.json"))

    def state(self, up_to: int | None = None) -> State | None:
        found = self.published(up_to)
        return None if found is None else State(self.spark, self.root, found["path"], ACTION_SCHEMA)

    def _create(self, name: str, text: str) -> bool:
        """Create a file that does not exist yet, whole; false if it exists."""
        aside, to = self._path(f"{self.root}/_aside-{uuid.uuid4().hex}"), self._path(name)
        self._fs.mkdirs(self._path(self.root))
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, to, self.spark.sparkContext._gateway.new_array(getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Exception:
            self._fs.delete(aside, False)
            if self._fs.exists(to):
                return False
            raise

    def initialise(self, schema_string: str, partition_columns: list[str] | None = None) -> int:
        rows = [{"action": "protocol", "protocolVersion": PROTOCOL}, {"action": "metaData", "schemaString": schema_string, "reason": ",".join(partition_columns or [])}]
        if not self.write_once(rows, 0):
            raise ValueError("the table exists already")
        return 0

    def write_once(self, rows: list[dict], version: int) -> bool:
        lines = [json.dumps(r | {"version": version, "seq": i}) for i, r in enumerate(rows)]
        return self._create(self._name(version), "\n".join(lines) + "\n")

    def commit(self, rows: list[dict], attempts: int = 10, first_wait: float = 0.1, longest_wait: float = 5.0, base: int | None = None) -> int:
        """Append a version; on a conflict try the next number, waiting longer each time.

        With ``base``, the version that the rows were made from, all files that the rows remove must still be live, and the schema the same: if one of the versions
        since says otherwise it is a :class:`Conflict`, and nothing is written.
        """
        gone = sorted({r["path"] for r in rows if r["action"] == "remove"})
        version, wait, seen = self.current_version() + 1, first_wait, base
        for _ in range(attempts):
            if base is not None and version - 1 > seen:
                self._check(gone, seen, version - 1)
                seen = version - 1
            if self.write_once(rows, version):
                return version
            version = max(version + 1, self.current_version() + 1)
            time.sleep(wait)
            wait = min(longest_wait, 2 * wait)
        raise RuntimeError(f"no version could be written in {attempts} attempts")

    def _check(self, gone: list[str], after: int, up_to: int) -> None:
        """Raise a conflict if the versions in (after, up_to] took away one of the files, or changed the schema."""
        there = [v for v in self.versions() if after < v <= up_to]
        wanted = self.spark.createDataFrame([(p,) for p in gone], "path string")
        if len(there) == up_to - after:
            since = self.spark.read.schema(ACTION_SCHEMA).json([self._name(v) for v in there])
            if since.filter(F.col("action").isin("metaData", "protocol")).limit(1).count():
                raise Conflict("the table's schema or protocol has changed")
            lost = net(since).filter("action = 'remove'").join(wanted, "path", "left_semi")
        else:  # some of the versions are purged already: look at the state itself
            lost = wanted.join(replay(self.actions(up_to)).select("path"), "path", "left_anti")
        if row := lost.select("path").first():
            raise Conflict(f"removed by another writer: {row['path']}")

    def add(self, files: list[dict]) -> int:
        return self.commit([{"action": "add", "dataChange": True} | f for f in files])

    def remove(self, paths: list[str], at: int) -> int:
        return self.commit([{"action": "remove", "path": p, "deletionTimestamp": at} for p in paths])

    def skip(self, path: str, reason: str, at: int, retry_after: int, count: int = 1) -> int:
        return self.commit([{"action": "mergeskip", "path": path, "reason": reason, "skipTimestamp": at, "retryAfter": retry_after, "skipCount": count}])

    def actions(self, up_to: int | None = None) -> DataFrame:
        """The checkpoint's rows and those of later versions: all manifests are opened; see :meth:`list` for a listing that opens what it needs."""
        last = self.state(up_to)
        since = self._since(self.checkpoint_version(up_to), up_to)
        return since if last is None else since.unionByName(last.actions())

    def _since(self, base: int | None, up_to: int | None = None) -> DataFrame:
        names = [self._name(v) for v in self.versions() if (base is None or v > base) and (up_to is None or v <= up_to)]
        return self.spark.read.schema(ACTION_SCHEMA).json(names) if names else self.spark.createDataFrame([], ACTION_SCHEMA)

    def list(self, partition: Filter | None = None, data: Filter | None = None, kinds: dict[str, str] | None = None, exclude_cooling_at: int | None = None, up_to: int | None = None) -> Listing:
        """Live files that the filters leave: the manifests that may hold them, less tombstones, and the versions since the last state."""
        base, last = self.checkpoint_version(up_to), self.state(up_to)
        changed = net(self._since(base, up_to))
        opened, total = ([], 0) if last is None else (last.pruned(partition), last.manifests().count())
        out = changed.filter("action = 'add'")
        if last is not None:
            out = out.unionByName(last.entries(opened).join(changed.select("path"), "path", "left_anti").select(out.columns))
        stages = [("entries", out)]
        if partition is not None:
            out = out.filter(compile_filter(partition, F.col("partitionValues"), "log"))
            stages.append(("after_partition", out))
        if data is not None:
            out = out.filter(may_match(data, F.col("minValues"), F.col("maxValues"), kinds))
            stages.append(("after_skipping", out))
        if exclude_cooling_at is not None:
            skips = self._since(base, up_to) if last is None else self._since(base, up_to).unionByName(last.rest())
            out = out.join(cooling_down(skips, exclude_cooling_at), "path", "left_anti")
            stages.append(("after_cooldown", out))
        return Listing(out, total, opened, stages)

    def read_version(self, version: int) -> DataFrame:
        return self.spark.read.schema(ACTION_SCHEMA).json(self._name(version))

    def checkpoint(self, keep_removed_since: int | None = None, full: bool = False, manifest_entries: int = MANIFEST_ENTRIES) -> int:
        """Write the state of the current version, then publish it. It is made from the last state and the versions since, or anew if ``full``.

        Removes whose files are in no manifest any more are kept if they are not older than ``keep_removed_since``.
        """
        version = self.current_version()
        base, last = self.checkpoint_version(version), None if full else self.state(version)
        if base == version and not full:
            return version
        since = self.actions(version) if last is None else self._since(base, version)
        name = f"state-{version}-{uuid.uuid4().hex}"
        numbers = write_state(self.spark, self.root, name, ACTION_SCHEMA, last, since, version, keep_removed_since, manifest_entries)
        if full and base == version:
            self._fs.delete(self._path(f"{self.root}/_last-{version}.json"), False)
        self._create(f"{self.root}/_last-{version}.json", json.dumps(numbers))  # of two writers the first is read
        return version

    def drop_states(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` published states, with the manifests that none of the kept ones names; how many states."""
        published = self._published()
        old = published[: max(0, len(published) - max(1, keep))]
        used = set()
        for v in published[len(old) :]:
            name = json.loads(self._text(f"{self.root}/_last-{v}.json"))["path"]
            used |= {name} | {r["f"] for r in State(self.spark, self.root, name, ACTION_SCHEMA).manifests().select(F.substring_index("path", "/", 1).alias("f")).distinct().collect()}
        mine = {f"-{v}-" for v in old}
        for v in old:
            self._fs.delete(self._path(f"{self.root}/_last-{v}.json"), False)
        for n, _ in self._listing():
            if n.startswith(("state-", "manifest-")) and n not in used and any(m in n for m in mine):
                self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return len(old)

    def auto_checkpoint(self, every: int = 10) -> int | None:
        last = self.checkpoint_version()
        return self.checkpoint() if self.current_version() - (last if last is not None else -1) >= every else None

    def purge(self, older_than: int, dry_run: bool = False) -> tuple[int, int]:
        """Delete versions below the checkpoint whose files are older; (found, deleted)."""
        base = self.checkpoint_version()
        old = [n for n, t in self._listing() if base is not None and n.endswith(".json") and n[:20].isdigit() and int(n[:20]) < base and t < older_than]
        if not dry_run:
            for n in old:
                self._fs.delete(self._path(f"{self.root}/{n}"), False)
        return len(old), 0 if dry_run else len(old)

    def _files(self) -> DataFrame:
        """``path, time`` (milliseconds) of the data files that exist."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.data)
        return found.select("path", F.unix_millis("modificationTime").alias("time"))

    def collect_garbage(self, removed_before: int, dry_run: bool = False) -> int:
        """Delete data files that were removed before that time, or left behind uncommitted; how many they are."""
        listed = f"{self.root}/_garbage-{uuid.uuid4().hex}"  # the list is written before any file goes
        garbage(self.actions(), self._files(), removed_before).write.parquet(listed)
        n = 0
        for row in self.spark.read.schema("path string").parquet(listed).toLocalIterator():
            n += 1
            if not dry_run:
                self._fs.delete(self._path(row["path"]), False)
        self._fs.delete(self._path(listed), True)
        return n

    # ------------------------------------------------------------------ data
    def _written(self, df: DataFrame, partition_by: list[str], max_records: int, stats: list[str]) -> list[dict]:
        """Write rows as Parquet beside the log; the files' adds, with counts and bounds of ``stats``. No reader sees them before they are committed."""
        batch = uuid.uuid4().hex
        writer = df.withColumn(_BATCH, F.lit(batch)).write.option("maxRecordsPerFile", max_records)
        writer.mode("append").partitionBy(_BATCH, *partition_by).parquet(self.data)
        at = f"{self.data}/{_BATCH}={batch}"
        if not self._fs.exists(self._path(at)):
            return []
        read = self._read([at])
        bounds = [c for name in stats for c in bounds_of(read, name)]
        keys = [F.first(F.col(c).cast("string")).alias(f"p_{c}") for c in partition_by]
        per_file = read.groupBy(_path_of_file().alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), *bounds, *keys)
        return [
            {"action": "add", "dataChange": True, "path": r["path"], "size": r["size"], "numRecords": r["n"], "partitionValues": {c: r[f"p_{c}"] for c in partition_by},
             "minValues": {c: r[f"min_{c}"] for c in stats}, "maxValues": {c: r[f"max_{c}"] for c in stats}}
            for r in per_file.toLocalIterator()
        ]

    def append(self, df: DataFrame, partition_by: list[str] | None = None, max_records: int = 0, stats: list[str] | None = None) -> int:
        """Write rows as Parquet beside the log and commit the files with counts and bounds of ``stats``."""
        return self.commit(self._written(df, partition_by or [], max_records, stats or []))

    def scan(self, partition: Filter | None = None, data: Filter | None = None, kinds: dict[str, str] | None = None, missing: str = "error") -> DataFrame:
        """The rows of the live files that the filters leave; files that are gone are an error, or are ignored if ``missing`` says so."""
        if missing not in ("error", "ignore"):
            raise ValueError(f"missing files are an error or ignored, not {missing!r}")
        paths = [r["path"] for r in self.list(partition, data, kinds).files.select("path").toLocalIterator()]
        if missing == "ignore":
            paths = [p for p in paths if self._fs.exists(self._path(p))]
        return self._read(paths) if paths else self.empty()

    def metadata(self) -> dict:
        """The metadata in force: schema string and partition columns."""
        last, since = self.state(), self._since(self.checkpoint_version())
        row = last_of(since if last is None else since.unionByName(last.rest()), "metaData").first()
        return {"schema": row["schemaString"] if row else None, "partitions": [c for c in (row["reason"] or "").split(",") if c] if row else []}

    def schema(self) -> T.StructType | None:
        """The schema of the metadata, if it has one: JSON or a list of columns with their types."""
        text = (self.metadata()["schema"] or "").strip()
        if text in ("", "{}"):
            return None
        return T.StructType.fromJson(json.loads(text)) if text.startswith("{") else T.StructType.fromDDL(text)

    def empty(self) -> DataFrame:
        """No rows, in the schema of the metadata, or of any file of the table's past that still exists."""
        if (kind := self.schema()) is not None:
            return self.spark.createDataFrame([], kind)
        try:
            return self._read([self.data]).limit(0)
        except AnalysisException as e:
            raise ValueError("the table holds no file and its metadata no schema") from e

    def _partitions(self) -> list[str]:
        """The partition columns: of the metadata, or of the live files."""
        if found := self.metadata()["partitions"]:
            return found
        row = self.list().files.select(F.map_keys("partitionValues").alias("k")).first()
        return list(row["k"] or []) if row else []

    def _read(self, paths: list[str]) -> DataFrame:
        reader, kind = self.spark.read.option("basePath", self.data), self.schema()
        return (reader.schema(kind) if kind is not None else reader).parquet(*paths).drop(_BATCH)

    def merge(self, paths: list[str], files: int = 1, stats: list[str] | None = None, attempts: int = 3) -> tuple[int, list[str]]:
        """Rewrite files as about ``files`` ones; the new files and the removes are one version. Unreadable ones are skipped and reported.

        If another writer takes some of them away meanwhile, what was written is deleted and the rest is merged again.
        """
        for attempt in range(attempts):
            base = self.current_version()
            if attempt:
                wanted = self.spark.createDataFrame([(p,) for p in paths], "path string")
                live = {r["path"] for r in self.list(up_to=base).files.join(wanted, "path", "left_semi").select("path").collect()}  # of the files asked for
                paths = [p for p in paths if p in live]
            if len(paths) < 2:
                raise ValueError("merging takes two files or more")
            good, bad = [], []
            for p in paths:
                try:
                    self._read([p]).limit(1).count()
                    good.append(p)
                except Exception:
                    bad.append(p)
            if len(good) < 2:
                raise ValueError(f"fewer than two of the files can be read; not: {bad}")
            rows = self._read(good)
            rows = rows.repartition(files) if files > 1 else rows.coalesce(1)
            written = self._written(rows, self._partitions(), 0, stats or [])
            try:
                return self.commit([*self._removes(good), *written], base=base), bad
            except Conflict:
                self.rollback(written)
        raise Conflict(f"other writers removed the files in each of {attempts} attempts")

    def compact(self, tiers: Tiers | None = None, attempts: int = 3) -> int:
        """Merge the live files of a partition and a tier of size as often as there are enough of them; the number of versions written.

        All groups that are due are rewritten by one job, a task a group, and are one version; the bounds of the same columns are kept. Meant to run after
        appends: files that other writers take away meanwhile are no fault, the rest is planned again.
        """
        tiers, done, failed = tiers or Tiers(), 0, 0
        while True:
            base = self.current_version()
            live = self.list(up_to=base, exclude_cooling_at=int(time.time() * 1000)).files
            keyed = live.select("path", "size", "version", F.to_json("partitionValues").alias("_p"), F.map_keys("minValues").alias("_stats"))
            plan = [(r["path"], r["chunk"]) for r in tiers.due(keyed, ["_p"]).select("path", "chunk").collect()]  # 10,000 files at most
            if not plan:
                return done
            chunks = {c: k for k, c in enumerate(sorted({c for _, c in plan}))}
            of_file = self.spark.createDataFrame([(p, chunks[c]) for p, c in plan], "_file string, _chunk int")
            stats = sorted(r["s"] for r in keyed.join(of_file, F.col("path") == F.col("_file"), "left_semi").select(F.explode("_stats").alias("s")).distinct().collect())  # columns
            rows = self._read([p for p, _ in plan])
            rows = rows.withColumn("_file", _path_of_file()).join(F.broadcast(of_file), "_file")
            written = self._written(rows.repartition(len(chunks), "_chunk").drop("_file", "_chunk"), self._partitions(), 0, stats)
            try:
                self.commit([*self._removes([p for p, _ in plan]), *[w | {"dataChange": False} for w in written]], base=base)
                done += 1
            except Conflict:
                self.rollback(written)
                failed += 1
                if failed == attempts:
                    raise

    def rollback(self, written: list[dict]) -> None:
        """Delete files that were written and not committed."""
        for f in written:
            self._fs.delete(self._path(f["path"]), False)

    @staticmethod
    def _removes(paths: list[str]) -> list[dict]:
        now = int(time.time() * 1000)
        return [{"action": "remove", "path": p, "deletionTimestamp": now} for p in paths]

    def delete_where(self, keep, stats: list[str] | None = None, attempts: int = 3) -> int:
        """Rewrite the live files that hold rows for which ``keep`` is not true, in one version.

        If another writer rewrites one of them meanwhile, the delete is done again on what is there then; rows appended meanwhile stay.
        """
        for _ in range(attempts):
            base = self.current_version()
            live = [r["path"] for r in self.list(up_to=base).files.select("path").toLocalIterator()]
            if not live:
                return base
            hit = self._read(live).filter(~F.coalesce(keep, F.lit(False))).select(_path_of_file().alias("path")).distinct()
            paths = [r["path"] for r in hit.toLocalIterator()]
            if not paths:
                return base
            written = self._written(self._read(paths).filter(keep), self._partitions(), 0, stats or [])
            try:
                return self.commit([*self._removes(paths), *written], base=base)
            except Conflict:
                self.rollback(written)
        raise Conflict(f"other writers rewrote the files in each of {attempts} attempts")
