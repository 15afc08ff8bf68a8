"""The stored text index: every kind of query gives the rows and scores of a scan."""

import pytest
from lodestone.operators import indexed, search
from lodestone.plans import nodes as q
from lodestone.plans.compile import matching
from lodestone.plans.parser import parse_query
from pyspark.sql import functions as F

from .conftest import SF

TEXTS = ["red fox runs", "the red fox", "fox red fox red", "a fox, a red hen", "redfox", None, "", "Fox! RED! hen?", "one two three four five", "five four three two one two three", "trhee wto", "two three " * 40]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t, f"title {k % 3} of fox" if k % 4 else None, k % 5, f'{{"k": {k}}}') for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, text string, title string, n int, props string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('index')}/i"
    indexed.TextIndex.write(table.filter("id % 2 = 0"), where, "id", ["text", "title"], part="a")
    out = indexed.TextIndex.write(table.filter("id % 2 = 1"), where, "id", ["text", "title"], part="b")
    out.validate()
    return out


T = lambda w: q.Term("text", w)
QUERIES = [
    T("red"), q.Term("text", "RED"), q.Term("text", "RED", analyzed=False), q.TermSet("text", ("hen", "five", "missing")), q.FullText("text", "red hen", "and"), q.FullText("text", "red hen", "or"), q.FullText("text", "red fox", "phrase"),
    q.Phrase("text", ("red", "fox")), q.Phrase("text", ("fox", "red", "fox")), q.Phrase("text", ("two", "three", "four")), q.Phrase("text", ("fox", "red"), slop=2), q.Phrase("text", ("four", "two"), slop=1), q.Phrase("text", ("one", "three"), slop=1),
    q.Phrase("text", ("two", "th"), prefix_last=True), q.Phrase("text", ("hen",)), q.Phrase("text", ("h",), prefix_last=True),
    q.Fuzzy("text", "three", 1), q.Fuzzy("text", "two", 1), q.Fuzzy("text", "two", 1, transposition_cost_one=False), q.Fuzzy("text", "fi", 0, prefix=True), q.Regex("text", "f.*"), q.Regex("text", "(one|hen)"),
    q.Wildcard("text", "r*d"), q.Wildcard("text", "*o*"), q.Wildcard("text", "*hr*e*"), q.Wildcard("text", "*e*h*"), q.Wildcard("text", "*e*h*", ordered=True), q.Wildcard("text", "f?x re*"), q.Wildcard("text", "*"), q.Wildcard("text", "hen"), q.Wildcard("nothing", "x*", lenient=True),
    q.Bool(must=(T("red"),), must_not=(T("hen"),)), q.Bool(must=(T("fox"), q.Range("n", 1, 3))), q.Bool(should=(T("hen"), q.Term("title", "fox")), minimum_should_match=2), q.Bool(should=(T("hen"), q.Range("n", 0, 0))), q.Bool(must_not=(T("red"),)),
    ~T("red"), q.Exists("text"), q.Bool(must=(q.Exists("title"), T("red"))), q.MatchAll(), q.MatchNone(), q.Boost(T("red"), 2.5), q.ConstScore(T("red"), 3.0), q.DisMax((T("red"), q.Term("title", "fox")), 0.3), q.Range("n", 2, None), q.JsonRange("props", "k", 2, 5),
    q.Bool(must=(q.Boost(q.Phrase("text", ("red", "fox")), 2.0),), should=(T("runs"), q.JsonTerm("props", "k", "3"))),
]


@pytest.mark.parametrize("query", QUERIES, ids=lambda n: n.kind)
def test_rows_and_scores_are_those_of_a_scan(table, index, query):
    got = {r["id"]: round(r["_score"], 9) for r in index.score(query, table, "id").collect()}
    assert got == {r["id"]: round(r["_score"], 9) for r in search.score(table, query).collect()}


@pytest.mark.parametrize("listed", [0, 3])
def test_many_terms_are_joined(table, index, monkeypatch, listed):
    monkeypatch.setattr(indexed, "LISTED", listed)
    for query in (q.Wildcard("text", "*e*"), q.TermSet("text", ("hen", "five", "one", "two")), q.Bool(must=(q.Regex("text", ".*"), T("red")), must_not=(q.Fuzzy("text", "hem", 1),))):
        assert sorted(r["id"] for r in index.ids(query, table, "id").collect()) == sorted(r["id"] for r in matching(table, query).collect())


def test_merged_parts_and_search(table, index, tmp_path):
    one = index.merge(f"file://{tmp_path}/one")
    one.validate()
    query = parse_query('red OR "two three" OR n:[4 TO 4]', ["text"])
    want = [(r["id"], round(r["_score"], 9)) for r in search.search(table, query, 4, "id", offset=1).collect()]
    for i in (index, one):
        assert [(r["id"], round(r["_score"], 9)) for r in search.search(table, query, 4, "id", offset=1, index=i).collect()] == want
        assert [r["id"] for r in search.search(table, query, 3, "id", order_by="n", index=i).collect()] == [r["id"] for r in search.search(table, query, 3, "id", order_by="n").collect()]
    assert one.document_frequency("text", ["two", "absent"]) == {"two": 3, "absent": 0}


def test_a_search_reads_no_text(table, index):
    plan = index.search(q.Bool(must=(q.Wildcard("text", "re*"), q.Phrase("text", ("red", "fox")))), table, 5, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan and "LogicalRDD" not in plan  # the table itself isn't in the plan
    with_range = index.ids(q.Bool(must=(T("red"), q.Range("n", 1, 3))), table, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "props" not in with_range.split("Project", 1)[1].split("LogicalRDD")[0]


def test_broken_index_and_modes(spark, table, index, tmp_path):
    one = index.merge(f"file://{tmp_path}/broken")
    wrong = spark.createDataFrame([("zz", 1, 1)], "term string, df long, tf long")
    wrong.write.parquet(f"{one.path}/terms/field=text/part=x")
    one.validate()  # a folder that the log doesn't name is no part
    wrong.write.mode("append").parquet(next(p["path"] for p in one.parts() if p["field"] == "text").replace("/*/", "/terms/"))
    with pytest.raises(ValueError, match="disagrees"):
        one.validate()
    with pytest.raises(ValueError, match="mode"):
        indexed.TextIndex.write(table, f"file://{tmp_path}/m", "id", ["text"], q.Fields(modes={"text": "exact_only"}))


def test_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = indexed.TextIndex.write(docs, f"file://{tmp_path}/d", "doc_id", ["text"])
    for query in (q.Fuzzy("text", "patehtic", 1), q.Wildcard("text", "*ntion*ingth*"), q.Phrase("text", ("of", "the")), parse_query("the AND NOT pathetic AND n_chars:[100 TO *]", ["text"])):
        scan = {r["doc_id"]: round(r["_score"], 6) for r in search.score(docs, query).collect()}
        assert {r["doc_id"]: round(r["_score"], 6) for r in index.score(query, docs, "doc_id").collect()} == scan and scan
    assert docs.select(F.count("*")).first()[0] == index.statistics("text")[0]


def test_postings_are_made_and_stored_where_their_rows_are(spark, table, tmp_path):
    got = search.postings(table, "id", "text")
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, text in enumerate(TEXTS):
        words = ["".join(c for c in w if c.isalnum()) for w in (text or "").lower().replace(",", " ").split()]
        for pos, w in enumerate(words):
            want.setdefault((w, k, len(words)), []).append(pos)
    assert {(r["term"], r["id"], r["length"]): r["positions"] for r in got.collect()} == want
    assert all(r["tf"] == len(r["positions"]) for r in got.collect())
    seen = []
    real = search.DataFrame.repartitionByRange
    try:
        search.DataFrame.repartitionByRange = lambda self, *a: (seen.append(a), real(self, *a))[1]
        search.PostingsTable.write(table, f"file://{tmp_path}/p", "id", "text").merge(f"file://{tmp_path}/q").validate()
    finally:
        search.DataFrame.repartitionByRange = real
    assert not seen
