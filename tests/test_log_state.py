"""The log's stored state: manifests, tombstones, compaction, what a listing opens, and writers that meet."""

import pytest
from lodestone.sources import datasource, state, txlog
from lodestone.sources.filters import Filter
from pyspark.sql import functions as F


@pytest.fixture
def log(spark, tmp_path):
    out = txlog.TransactionLog(spark, f"file://{tmp_path}/t")
    out.initialise("id long, p string", ["p"])
    return out


def entry(path, p, **more):
    return {"path": path, "partitionValues": {"p": p}, "size": 10, "numRecords": 1} | more


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_manifests_are_shared_and_pruned(spark, log):
    expected = set()
    for step, values in enumerate((range(0, 4), range(4, 8), range(8, 12))):
        log.add([entry(f"f{p}-{k}", str(p)) for p in values for k in range(2)])
        expected |= {f"f{p}-{k}" for p in values for k in range(2)}
        log.checkpoint(manifest_entries=4)
        assert log.published()["manifests"] == 2 * (step + 1) and log.published()["rewritten"] == 0
    # numbers are compared as numbers: "10" and "11" are above 9
    for f, want in ((Filter("gte", "p", "10"), {10, 11}), (Filter("eq", "p", "3"), {3}), (Filter("in", "p", ["0", "7"]), {0, 7}), (Filter("lt", "p", "2"), {0, 1}), (~Filter("eq", "p", "3"), set(range(12)) - {3})):
        found = log.list(f)
        assert paths(found.files) == sorted(f"f{p}-{k}" for p in want for k in range(2))
        counts = found.counts()
        assert counts["manifests"] == 6 and counts["manifests_opened"] <= (6 if f.op == "not" else 3)
    assert log.list(Filter("eq", "p", "3")).opened and len(log.list(Filter("eq", "p", "3")).opened) == 1
    assert set(paths(log.list().files)) == set(paths(txlog.replay(log.actions()))) == expected
    assert log.state().pruned(from_version=2) != log.state().pruned() and paths(log.list(up_to=1).files) == sorted(f"f{p}-{k}" for p in range(4) for k in range(2))


def test_tombstones_then_compaction(log):
    log.add([entry(f"a{k:02d}", str(k % 2)) for k in range(30)])
    log.checkpoint(manifest_entries=10)
    before = set(log.state().pruned())
    log.remove(["a00", "a01"], 5)
    log.checkpoint(manifest_entries=10)
    assert set(log.state().pruned()) == before and log.state().removed().count() == 2  # 2 of 30 wait beside the manifests
    assert log.list().files.count() == 28
    log.add([entry("a00", "0", numRecords=7)])  # comes back
    log.add([entry("a05", "1", numRecords=9)])  # is written anew without a remove
    log.checkpoint(manifest_entries=10)
    rows = {r["path"]: r["numRecords"] for r in log.list().files.collect()}
    assert len(rows) == 29 and rows["a00"] == 7 and rows["a05"] == 9
    log.remove([f"a{k:02d}" for k in range(10, 16)], 6)
    log.checkpoint(manifest_entries=10, keep_removed_since=6)
    after = set(log.state().pruned())
    assert log.published()["rewritten"] >= 1 and log.state().removed().filter("not applied").count() == 0
    assert log.list().files.count() == 23 and {r["path"] for r in txlog.tombstones(log.actions()).collect()} >= {f"a{k}" for k in range(10, 16)}
    untouched = before & after
    assert len(untouched) < len(before)
    full = paths(log.list().files)
    log.checkpoint(full=True)
    assert paths(log.list().files) == full == paths(txlog.replay(log.actions())) and log.published()["manifests"] == 1


def test_small_manifests_are_combined(log, monkeypatch):
    monkeypatch.setattr(state, "MANY", 3)
    for k in range(6):
        log.add([entry(f"s{k:02d}", "x")])
        log.checkpoint(manifest_entries=100)
    assert log.published()["manifests"] <= 4 and log.list().files.count() == 6
    assert log.drop_states(keep=1) == 5 and log.list().files.count() == 6 and log.drop_states(keep=1) == 0


def test_null_and_odd_partition_values(log):
    log.add([entry("n", None), entry("e", ""), entry("w", "word"), entry("m", "-3")])
    log.checkpoint()
    for f, want in ((Filter("is_null", "p"), ["e", "n"]), (Filter("is_not_null", "p"), ["m", "w"]), (Filter("gt", "p", "-5"), ["m", "w"]), (Filter("neq", "p", "word"), ["e", "m", "n"]), (Filter("starts_with", "p", "wo"), ["w"]), (Filter("eq", "q", "1"), [])):
        assert paths(log.list(f).files) == want, f


# ---------------------------------------------------------------------- writers that meet
def rows(spark, lo, hi, p="1"):
    return spark.range(lo, hi).select("id", F.lit(p).alias("p")).coalesce(1)


def between(log, monkeypatch, act):
    """Let another writer act once, after the rewrite was read and before it is committed."""
    original, done = log.commit, []

    def commit(*args, **kwargs):
        if not done:
            done.append(True)
            act()
        return original(*args, **kwargs)

    monkeypatch.setattr(log, "commit", commit)


def test_two_merges_leave_every_row_once(spark, log, monkeypatch):
    other = txlog.TransactionLog(spark, log.data.rsplit("/", 1)[0])
    for k in range(3):
        log.append(rows(spark, 10 * k, 10 * k + 10), ["p"])
    live = paths(log.list().files)
    between(log, monkeypatch, lambda: other.merge(live[:2]))
    with pytest.raises(ValueError):  # one of the three files is left, and one is no merge
        log.merge(live)
    assert sorted(r["id"] for r in log.scan().collect()) == list(range(30)) and log.list().files.count() == 2
    assert log._files().count() == 4  # what the loser wrote is gone: three appended, one merged


def test_delete_meets_merge_and_append(spark, log, monkeypatch):
    other = txlog.TransactionLog(spark, log.data.rsplit("/", 1)[0])
    for k in range(2):
        log.append(rows(spark, 10 * k, 10 * k + 10), ["p"])
    live = paths(log.list().files)

    def act():
        other.merge(live)
        other.append(rows(spark, 20, 30, "2"), ["p"])
        other.checkpoint()
        other.purge(2**62)

    between(log, monkeypatch, act)
    log.delete_where(F.col("id") % 2 == 0)
    assert sorted(r["id"] for r in log.scan().collect()) == [i for i in range(30) if i % 2 == 0]


def test_refused_commits_write_nothing(spark, log):
    log.append(rows(spark, 0, 5), ["p"])
    (path,) = paths(log.list().files)
    base = log.current_version()
    log.remove([path], 1)
    with pytest.raises(txlog.Conflict, match="another writer"):
        log.commit([{"action": "remove", "path": path}], base=base)
    log.commit([{"action": "metaData", "schemaString": "id long, p string, q int"}])
    with pytest.raises(txlog.Conflict, match="schema"):
        log.commit([{"action": "add", "path": "x"}], base=base)
    assert log.current_version() == base + 2
    assert log.commit([{"action": "add", "path": "x", "partitionValues": {}}]) == base + 3  # an append asks for nothing


def test_a_table_without_rows(spark, log):
    assert log.scan().columns == ["id", "p"] and log.scan().count() == 0
    log.append(rows(spark, 0, 5), ["p"])
    log.delete_where(F.lit(False))
    assert log.scan().count() == 0 and log.scan().dtypes == [("id", "bigint"), ("p", "string")]
    assert log.delete_where(F.lit(False)) == log.current_version()


def test_partition_values_of_any_characters(spark, log):
    values = ["a b", "50%", "x:y", "ü/é", "p=q", "plus+"]
    for k, v in enumerate(values):
        log.append(rows(spark, 10 * k, 10 * k + 10, v), ["p"])
    log.delete_where(F.col("id") % 2 == 0)
    assert sorted({r["p"] for r in log.scan().collect()}) == sorted(values) and log.scan().count() == 30
    assert log.collect_garbage(2**62) == 6 and log.scan(Filter("eq", "p", "50%")).count() == 5
    assert datasource.rows(spark, log.data.rsplit("/", 1)[0], Filter("in", "p", values[:3])).count() == 15
