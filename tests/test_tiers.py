"""Tiered merging: the number of files and parts stays logarithmic, rows and searches stay the same."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators.indexed import TextIndex
from lodestone.plans import nodes as q
from lodestone.sources import txlog
from lodestone.sources.filters import Filter
from lodestone.sources.tiers import Tiers


def files(spark, sizes):
    return spark.createDataFrame([(f"f{k:03}", "p", s, k) for k, s in enumerate(sizes)], "path string, g string, size long, version long")


def test_due(spark):
    tiers = Tiers(factor=3, floor=10, ceiling=1000)
    of = lambda s: spark.range(1).select(tiers.of(F.lit(s))).first()[0]
    assert [of(s) for s in (None, 0, 10, 11, 30, 31, 90, 91)] == [0, 0, 0, 1, 1, 2, 2, 3]
    due = lambda *sizes: sorted(r["path"] for r in tiers.due(files(spark, sizes), ["g"]).collect())
    assert due(1, 2) == [] and due(1, 2, 30) == [] and due(5000, 5000, 5000) == [] and due() == []
    assert due(30, 1, None, 2, 3) == ["f001", "f002", "f003"]  # the oldest of the tier; the fourth waits
    assert len(due(*[1] * 7, *[20] * 3)) == 9
    chunks = tiers.due(files(spark, [1] * 7 + [20] * 3), ["g"], at_once=3).collect()
    assert len(chunks) == 3 and len({r["chunk"] for r in chunks}) == 1
    for bad in (dict(factor=1), dict(floor=0), dict(floor=2, ceiling=1)):
        with pytest.raises(ValueError, match="tiers"):
            Tiers(**bad)


def test_log_of_many_appends(spark, tmp_path):
    log = txlog.TransactionLog(spark, f"file://{tmp_path}/t")
    log.initialise("{}", ["p"])
    rows = lambda k: spark.range(k * 5, k * 5 + 5).select("id", (F.col("id") % 2).cast("string").alias("p"), F.concat(F.lit("v"), "id").alias("t")).coalesce(1)
    one = 700  # bytes, about those of one file
    tiers = Tiers(factor=3, floor=2 * one, ceiling=1 << 30)
    for k in range(15):
        log.append(rows(k), ["p"], stats=["id"])
        log.compact(tiers)
    live = log.list().files
    per_part = {r["p"]: r["n"] for r in live.groupBy(F.col("partitionValues")["p"].alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per_part) == {"0", "1"} and max(per_part.values()) <= 6, per_part
    assert sorted(r["id"] for r in log.scan().collect()) == list(range(75))
    assert live.agg(F.sum("numRecords")).first()[0] == 75 and live.filter("minValues['id'] is null").count() == 0
    assert sorted(r["id"] for r in log.scan(Filter("eq", "p", "1"), Filter("gte", "id", "70"), {"id": "long"}).filter("id >= 70").collect()) == [71, 73]
    assert log.compact(tiers) == 0


def test_compaction_meets_other_writers(spark, tmp_path, monkeypatch):
    log = txlog.TransactionLog(spark, f"file://{tmp_path}/t")
    log.initialise("{}")
    for k in range(3):
        log.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    whole, hits = log._written, []

    def deletes_first(*args):
        if not hits:
            hits.append(1)
            log.delete_where(F.col("id") != 4)  # takes one of the three files away while they are being merged
        return whole(*args)

    monkeypatch.setattr(log, "_written", deletes_first)
    assert log.compact(Tiers(3)) == 1
    assert sorted(r["id"] for r in log.scan().collect()) == [i for i in range(30) if i != 4] and log.list().files.count() == 1


TEXTS = ["red fox", "blue fox runs", "red hen", "a hen and a fox", "nothing here", "fox fox"]


def test_index_of_many_parts(spark, tmp_path):
    where = f"file://{tmp_path}/i"
    table = spark.createDataFrame([(k, f"{TEXTS[k % 6]} n{k}") for k in range(20)], "id long, text string")
    for k in range(10):
        index = TextIndex.write(table.filter(F.floor(F.col("id") / 2) == k).coalesce(1), where, "id", ["text"], part=f"p{k}")
        index.compact(Tiers(factor=3, floor=20, ceiling=10**9))
    index.validate()
    assert len(index.parts()) <= 5
    scan = {r["id"]: round(r["_score"], 9) for r in search.score(table, q.Bool(should=(q.Term("text", "fox"), q.Phrase("text", ("red", "hen"))))).collect()}
    found = {r["id"]: round(r["_score"], 9) for r in index.score(q.Bool(should=(q.Term("text", "fox"), q.Phrase("text", ("red", "hen")))), table, "id").collect()}
    assert found == scan
    with pytest.raises(ValueError, match="merged"):
        TextIndex.write(table, where, "id", ["text"], part="p0")
    early = TextIndex(spark, where)
    early.parts()
    last = TextIndex.write(spark.createDataFrame([(100, "fox of its own")], "id long, text string"), where, "id", ["text"], part="more")
    assert early.statistics("text")[0] == 20 and last.statistics("text")[0] == 21  # a reader keeps the parts it began with
    last = TextIndex.write(spark.createDataFrame([(100, "a hen instead")], "id long, text string"), where, "id", ["text"], part="more")
    assert last.statistics("text")[0] == 21 and last.document_frequency("text", ["own", "instead"]) == {"own": 0, "instead": 1}
    before = last.validate()
    assert last.drop_removed(2**62) > 0 and last.validate() == before


def test_indexes_are_combined_without_rewriting(spark, tmp_path):
    make = lambda name, rows, fields=None: TextIndex.write(spark.createDataFrame(rows, "id long, text string"), f"file://{tmp_path}/{name}", "id", ["text"], fields)
    a, b = make("a", [(1, "red fox"), (2, "hen")]), make("b", [(3, "fox hen fox")])
    both = TextIndex.combine([a, b], f"file://{tmp_path}/both")
    both.validate()
    assert both.statistics("text") == (3, 6) and both.document_frequency("text", ["fox"]) == {"fox": 2}
    assert not (tmp_path / "both" / "postings").exists()
    table = spark.createDataFrame([(1, "red fox"), (2, "hen"), (3, "fox hen fox")], "id long, text string")
    assert {r["id"] for r in both.ids(q.Phrase("text", ("hen", "fox")), table, "id").collect()} == {3}
    both.compact(Tiers(factor=2, floor=10, ceiling=10**9))
    assert len(both.parts()) == 1 and both.statistics("text") == (3, 6) and len(a.parts()) == 1
    a.validate()
    with pytest.raises(ValueError, match="tokenizer"):
        TextIndex.combine([a, make("c", [(9, "x")], q.Fields(tokenizers={"text": "whitespace"}))], f"file://{tmp_path}/no")
