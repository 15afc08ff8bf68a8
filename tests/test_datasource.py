"""The log as a data source: rows equal those of a scan, and what cannot match is never opened."""

import datetime

import pytest
from lodestone.sources import datasource, txlog
from lodestone.sources.filters import Filter
from pyspark.sql import functions as F

COLUMNS = "id long, name string, day date, p string, k int"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    out = txlog.TransactionLog(spark, f"file://{tmp_path_factory.mktemp('source')}/t")
    out.initialise(COLUMNS, ["p", "k"])
    rows = spark.range(120).select("id", F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("name"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("p"), (F.floor(F.col("id") / 40) * 5).cast("int").alias("k"))
    stats = ["id", "name", "day"]
    out.append(rows.filter("id < 40").coalesce(1), ["p", "k"], stats=stats)
    out.append(rows.filter("id between 40 and 79").coalesce(1), ["p", "k"], stats=stats)
    out.checkpoint(manifest_entries=2)
    out.delete_where(F.col("id") % 10 != 7, stats=stats)
    out.checkpoint(manifest_entries=2)
    out.append(rows.filter("id >= 80").coalesce(1), ["p", "k"], stats=stats)
    out.delete_where(F.col("id") != 81, stats=stats)
    return out


def table(log):
    return log.data.rsplit("/", 1)[0]


X = Filter
CONDITIONS = [
    (X("eq", "p", "1"), "p = '1'"), (X("is_null", "p"), "p is null"), (X("is_not_null", "p") & X("gt", "k", 0), "p is not null and k > 0"), (X("in", "k", [5, 10]), "k in (5, 10)"), (X("gte", "k", 10), "k >= 10"),
    (X("gte", "id", 20) & X("lte", "id", 45), "id between 20 and 45"), (X("gte", "name", "n0100"), "name >= 'n0100'"), (X("starts_with", "name", "n003"), "name like 'n003%'"), (X("eq", "day", datetime.date(2024, 2, 10)), "day = date'2024-02-10'"),
    (~X("eq", "p", "2"), "not (p = '2')"), (X("neq", "k", 5), "k <> 5"), (X("eq", "id", 7), "id = 7"), (X("is_null", "id"), "id is null"), (X("eq", "p", "1") | X("eq", "k", 5), "p = '1' or k = 5"),
    (X("lt", "day", datetime.date(2024, 1, 5)) & X("eq", "p", "2"), "day < date'2024-01-05' and p = '2'"), (X("contains", "name", "11") & X("lt", "k", 100), "name like '%11%'"),
]


@pytest.mark.parametrize(("where", "condition"), CONDITIONS, ids=lambda x: x if isinstance(x, str) else "")
def test_rows_are_those_of_a_scan(spark, log, where, condition):
    want = sorted((r["id"], r["name"], r["day"], r["p"], r["k"]) for r in log.scan().filter(condition).select("id", "name", "day", "p", "k").collect())
    assert sorted((tuple(r) for r in datasource.rows(spark, table(log), where).collect()), key=lambda r: r[0]) == want


def test_whole_table_and_chosen_columns(spark, log):
    whole = datasource.rows(spark, table(log))
    assert whole.filter("k = 10").count() == 39 and sorted(r["id"] for r in whole.collect()) == [i for i in range(120) if not (i < 80 and i % 10 == 7) and i != 81]
    few = datasource.rows(spark, table(log), Filter("eq", "k", 10), "k int, id long, _file string")
    assert few.columns == ["k", "id", "_file"] and few.select("_file").distinct().count() == len({r["path"] for r in log.list(Filter("eq", "k", "10")).files.collect()})
    assert datasource.rows(spark, table(log), Filter("eq", "id", 3), "id long, absent int").collect() == [(3, None)]
    with pytest.raises(Exception, match="is not read|UNRESOLVED"):
        datasource.rows(spark, table(log), Filter("eq", "id", 3), "k int").count()


def test_files_that_cannot_match_are_not_opened(spark, log, tmp_path):
    """Their files are gone: a filter that leaves them out reads the table all the same."""
    other = txlog.TransactionLog(spark, f"file://{tmp_path}/copy")
    other.initialise(COLUMNS, ["p", "k"])
    other.append(datasource.rows(spark, table(log)).coalesce(1), ["p", "k"], stats=["id", "day"])
    other.checkpoint(manifest_entries=2)
    for f in other.list(Filter("eq", "k", "5")).files.collect():
        other._fs.delete(other._path(f["path"]), False)
    there = lambda where: datasource.rows(spark, f"{tmp_path}/copy", where).count()
    assert there(Filter("eq", "k", 10)) == 39 and there(Filter("gte", "id", 85)) == 35 and there(Filter("gt", "day", datetime.date(2024, 4, 1))) == 28
    with pytest.raises(Exception, match="FileNotFound"):
        there(None)


def test_one_partition_a_manifest(spark, log):
    schema = spark.createDataFrame([], COLUMNS).schema
    every = datasource.LogReader(table(log), schema, []).partitions()
    some = datasource.LogReader(table(log), schema, [["eq", "p", "1"]]).partitions()
    assert 1 <= len([g for g in some if g.manifest]) < len([g for g in every if g.manifest]) and all(f["partitionValues"]["p"] == "1" for g in some for f in g.files)


def test_no_schema_is_an_error(spark, tmp_path):
    txlog.TransactionLog(spark, f"file://{tmp_path}/t").initialise("{}")
    with pytest.raises(Exception, match="schema"):
        datasource.rows(spark, f"{tmp_path}/t").count()
