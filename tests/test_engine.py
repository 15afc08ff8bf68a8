"""Unit cases of the engine: predicates, parser, addresses, aggregations, filters, the log, Delta logs and streams."""

import itertools
import json
import os
import re

import pytest
from lodestone.functions import analysis, ip
from lodestone.operators import aggs, joins, search
from lodestone.plans import nodes as q
from lodestone.plans.compile import matching
from lodestone.plans.parser import parse_lenient, parse_query
from lodestone.sources import delta, filters, iceberg, parquet, txlog
from lodestone.streaming import streams
from pyspark.sql import functions as F


#: The smallest words that the edges need: one letter more, one less, one other, neighbours swapped, a digit, a letter of two bytes.
WORDS = ("oak", "oaks", "ok", "oar", "oka", "elm", "7", "fée")


def every_line():
    """All texts of up to two of the words, every order of three of them, and what surrounds words: capitals, signs, blanks, nothing, null."""
    texts = [" ".join(p) for k in (1, 2) for p in itertools.product(WORDS, repeat=k)]
    texts += [" ".join(p) for p in itertools.permutations(("oak", "elm", "7"))]
    return [*texts, "OAK-Elm", "(oak)elm;7", "oak_elm", "oakelm", " \t", "", None]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(every_line())), "id long, line string").repartition(3)


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def edits(a, b, swaps=True):
    """Least number of insertions, deletions, replacements and swaps of neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if swaps and min(i, j) > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def follows(ts, first, then, slop=0):
    return any(a == first and b == then and abs(j - 1 - i) <= slop for i, a in enumerate(ts) for j, b in enumerate(ts) if i != j)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def check(lines, query, holds):
    """The rows found are those for which ``holds`` says so, of the words and the text."""
    want = [i for i, text in enumerate(every_line()) if holds(tokens(text), text)]
    assert ids(matching(lines, query)) == want
    return want


L = "line"


@pytest.mark.parametrize(
    ("query", "holds"),
    [
        (q.Term(L, "Oak"), lambda ts, _: "oak" in ts),
        (q.Term(L, "Oak", analyzed=False), lambda *_: False),
        (q.Term(L, "fÉe"), lambda ts, _: "fée" in ts),
        (q.TermSet(L, ("elm", "OKA")), lambda ts, _: {"elm", "oka"} & set(ts)),
        (q.FullText(L, "elm, OAK!", "and"), lambda ts, _: {"elm", "oak"} <= set(ts)),
        (q.Phrase(L, ("oak", "elm")), lambda ts, _: follows(ts, "oak", "elm")),
        (q.Phrase(L, ("oak", "elm"), slop=1), lambda ts, _: follows(ts, "oak", "elm", 1)),
        (q.Phrase(L, ("oak", "elm"), slop=2), lambda ts, _: follows(ts, "oak", "elm", 2)),
        (q.Phrase(L, ("elm", "oa"), prefix_last=True), lambda ts, _: any(follows(ts, "elm", w) for w in WORDS if w.startswith("oa"))),
        (q.Fuzzy(L, "oak", 1), lambda ts, _: any(edits(t, "oak") <= 1 for t in ts)),
        (q.Fuzzy(L, "oak", 1, transposition_cost_one=False), lambda ts, _: any(edits(t, "oak", swaps=False) <= 1 for t in ts)),
        (q.Fuzzy(L, "oka", 2), lambda ts, _: any(edits(t, "oka") <= 2 for t in ts)),
        (q.Fuzzy(L, "ao", 1, prefix=True), lambda ts, _: any(edits(t[:k], "ao") <= 1 for t in ts for k in range(len(t) + 1))),
        (q.Regex(L, "o.k?"), lambda ts, _: any(re.fullmatch("o.k?", t) for t in ts)),
        (q.Wildcard(L, "o?*"), lambda ts, _: any(re.fullmatch("o..*", t) for t in ts)),
        (q.Wildcard(L, "*k*a*"), lambda ts, _: any("k" in t for t in ts) and any("a" in t for t in ts)),
        (q.Wildcard(L, "*k*a*", ordered=True), lambda ts, _: any(re.fullmatch(".*k.*a.*", t) for t in ts)),
        (q.Exists(L), lambda _, text: text is not None),
        (~q.Term(L, "oak"), lambda ts, _: "oak" not in ts),
        (q.Bool(must_not=(q.Term(L, "oak"),)), lambda *_: False),
        (q.Bool(must=(q.Term(L, "7"),), must_not=(q.Exists(L),)), lambda *_: False),
        (q.Bool(should=tuple(q.Term(L, w) for w in ("oak", "elm", "7")), minimum_should_match=2), lambda ts, _: len({"oak", "elm", "7"} & set(ts)) >= 2),
    ],
)
def test_predicates(lines, query, holds):
    check(lines, query, holds)
    assert q.Query.from_json(json.loads(json.dumps(query.to_json()))).to_json() == query.to_json()


@pytest.mark.parametrize(
    ("text", "holds"),
    [
        ("oak AND elm", lambda ts, _: {"oak", "elm"} <= set(ts)), ("oak elm", lambda ts, _: {"oak", "elm"} & set(ts)), ("+oak -7", lambda ts, _: "oak" in ts and "7" not in ts),
        ('line:"elm oak"', lambda ts, _: follows(ts, "elm", "oak")), ("(ok OR oka) AND NOT oar", lambda ts, _: {"ok", "oka"} & set(ts) and "oar" not in ts), ("line:oa*", lambda ts, _: any(t.startswith("oa") for t in ts)),
        ("line:/oa.?s/", lambda ts, _: "oaks" in ts), ("line:*", lambda _, text: text is not None), ("oak~1", lambda ts, _: any(edits(t, "oak") <= 1 for t in ts)), ("*", lambda *_: True),
    ],
)
def test_parser(lines, text, holds):
    assert check(lines, parse_query(text, ["line"]), holds)


def test_parsed_bounds(lines):
    for text, want in (("id:[2 TO 4}", [2, 3]), ("id:{2 TO 4]", [3, 4]), ("id:<1", [0]), (f"id:>={len(every_line()) - 1}", [len(every_line()) - 1])):
        assert ids(matching(lines, parse_query(text, ["line"]))) == want


@pytest.mark.parametrize("text", ["", "  ", "a AND", "(a", "OR b", "a OR OR b", "a)"])
def test_parse_errors(text):
    with pytest.raises(ValueError):
        parse_query(text, ["title"])
    assert parse_lenient(text or "x AND", ["title"])[1]


def test_node_errors(lines):
    for make in (lambda: q.Fuzzy("t", "x", 3), lambda: q.Boost(q.MatchAll(), 0), lambda: q.ConstScore(q.MatchAll(), -1), lambda: q.Phrase("t", ()), lambda: q.Bool(), lambda: q.Term("t", None)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(ValueError):
        matching(lines, q.Term("missing", "x"))
    with pytest.raises(ValueError):
        matching(lines, q.Exists("line"), q.Fields(fast=frozenset()))


def test_token_limits(spark):
    df = spark.createDataFrame([("a" * 30 + " " + "b" * 50 + " " + "c" * 39,)], "t string")
    sizes = lambda name: df.select(F.size(analysis.tokens(F.col("t"), name))).first()[0]
    assert sizes("default") == 3 and sizes("default_limit_40") == 2
    with pytest.raises(ValueError):
        analysis.resolve("nonsense")


def test_addresses(spark):
    df = spark.createDataFrame([(1, "192.168.1.1"), (2, "10.0.0.1"), (3, "2001:db8::1"), (4, "x"), (5, None)], "id long, a string")
    fields = q.Fields(ips=frozenset({"a"}))
    find = lambda text: ids(matching(df, parse_query(text, ["a"], fields=fields), fields))
    assert find("192.168.1.*") == [1] and find("a:10.0.0.0/8") == [2]
    assert ids(matching(df, q.Term("a", "2001:db8::/32"), fields)) == [3]
    with pytest.raises(ValueError):
        ip.expand("10.*.1.*")
    assert ip.matches_all(*ip.expand("0.0.0.0/0"))


def test_ranking(lines):
    """A rare word, weighed up, comes before a frequent one; of equal scores the smaller id; shorter texts before longer ones."""
    texts = every_line()
    query = q.Bool(should=(q.Boost(q.Phrase("line", ("fée", "7")), 5.0), q.Term("line", "oak")))
    top = [r["id"] for r in search.search(lines, query, 3, "id").collect()]
    assert [texts[i] for i in top] == ["fée 7", "oak oak", "oak"]
    assert search.doc_freq(lines, "line", "oak") == sum("oak" in tokens(t) for t in texts)
    (shown,) = search.snippets(lines.filter(F.col("line") == "oak elm 7"), "line", ["elm"]).collect()
    assert shown["snippet"] == "oak <b>elm</b> 7"


def test_aggregations(spark):
    """Tools: three kinds, weights on both sides of each bound, one far from the others."""
    rows = [("saw", 40, 2.0), ("saw", 99, 4.0), ("awl", 100, 1.0), ("awl", 130, 3.0), ("awl", 299, 5.0), ("axe", 300, 2.5), ("axe", 410, 3.5), ("awl", 760, 6.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, kind string, weight long, rating double")
    ranges = {"range": {"field": "weight", "ranges": [{"key": "light", "to": 100}, {"key": "mid", "from": 100, "to": 300}, {"key": "heavy", "from": 300}]}}
    assert {r["key"]: r["doc_count"] for r in aggs.aggregate(df, ranges).collect()} == {"light": 2, "mid": 3, "heavy": 3}
    bounded = aggs.aggregate(df, {"histogram": {"field": "weight", "interval": 100, "hard_bounds": {"min": 50, "max": 300}}}).collect()
    assert sorted((r["key"], r["doc_count"]) for r in bounded) == [(0, 1), (100, 2), (200, 1), (300, 1)]
    full = aggs.aggregate(df, {"histogram": {"field": "weight", "interval": 100}}).collect()
    assert sorted(r["key"] for r in full) == [100 * k for k in range(8)] and [r["doc_count"] for r in full if r["key"] == 500] == [0]
    wide = aggs.aggregate(df, {"histogram": {"field": "weight", "interval": 400, "extended_bounds": {"min": -300, "max": 1300}}}).collect()
    assert sorted(r["key"] for r in wide) == [-400, 0, 400, 800, 1200]
    terms = aggs.aggregate(df, {"terms": {"field": "kind", "size": 1}, "aggs": {"r": {"avg": {"field": "rating"}}}}).collect()
    assert [(r["key"], r["doc_count"], r["r"]) for r in terms] == [("awl", 4, 3.75)]
    empty = aggs.aggregate(df, {"stats": {"field": "weight"}}, q.MatchNone()).first()
    assert empty["count"] == 0 and empty["sum"] is None
    assert aggs.schema_of(df, ranges).names[:2] == ["key", "from"]
    tree = {"terms": {"field": "kind"}, "aggs": {"w": {"max": {"field": "weight"}}, "a": {"range": ranges["range"]}, "b": {"terms": {"field": "id"}}}}
    each = aggs.aggregate_each(df, tree, "t")
    assert sorted(each) == ["t>a", "t>b"] and {r["key_0"]: r["w"] for r in each["t>b"].collect()} == {"saw": 99, "awl": 760, "axe": 410}
    for bad in ({"terms": {"field": "kind", "size": 0}}, {"histogram": {"field": "weight", "interval": 0}}, {"multi_terms": {"terms": ["kind"]}}, tree):
        with pytest.raises(ValueError):
            aggs.aggregate(df, bad)


def test_array_metrics_and_top_hits(spark):
    df = spark.createDataFrame([(1, "x", [1, 2, 3]), (2, "x", [None, 5]), (3, "y", []), (4, "y", None)], "id long, k string, v array<int>")
    assert aggs.aggregate(df, {"value_count": {"field": "v"}}).first()["value"] == 4
    got = {r["key"]: (r["s_count"], r["s_sum"], r["s_max"], r["s_avg"]) for r in aggs.aggregate(df, {"terms": {"field": "k"}, "aggs": {"s": {"stats": {"field": "v"}}}}).collect()}
    assert got == {"x": (4, 11.0, 5.0, 2.75), "y": (0, None, None, None)}
    hits = aggs.aggregate(df, {"terms": {"field": "k"}, "aggs": {"h": {"top_hits": {"size": 1, "sort": [{"id": "desc"}], "_source": ["id"]}}}})
    assert {r["key"]: [h["id"] for h in r["h"]] for r in hits.collect()} == {"x": [2], "y": [4]}
    with pytest.raises(ValueError):
        aggs.aggregate(df, {"cardinality": {"field": "v"}})


def test_retrieval(lines):
    texts = every_line()
    held = sum(t is not None for t in texts)
    batches = list(search.stream_batches(lines, q.Exists("line"), ["id", "line"], rows=50))
    assert [b.num_rows for b in batches] == [50] * (held // 50) + [held % 50] and batches[0].schema.names == ["id", "line"]
    assert search.document(lines, "id", 3) == {"id": 3, "line": WORDS[3]} and search.document(lines, "id", len(texts)) is None
    assert json.loads(bytes(search.binary_docs(lines, "id").filter("id = 7").first()["doc"])) == {"id": 7, "line": "fée"}
    with pytest.raises(ValueError):
        parse_query("oak", ["nothing"], schema=lines.schema)
    check(lines, parse_query("oak", schema=lines.schema), lambda ts, _: "oak" in ts)
    typed = q.Range("id", 2, 3, type="INTEGER")
    assert q.Query.from_json(typed.to_json()) == typed


def test_address_keys(spark):
    import ipaddress

    texts = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::ff00:42:8329", "2001:0DB8:0:0:1:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", ":::", "1:2", "", " 10.0.0.1 ", None, "fe80::0:0:1"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    for r in df.select("a", ip.ip_key(F.col("a")).alias("k"), ip.ip_text(ip.ip_key(F.col("a"))).alias("t")).collect():
        try:
            want = ip.key_of(r["a"])
        except (ValueError, AttributeError):
            want = None
        assert (bytes(r["k"]) if r["k"] is not None else None) == want, r["a"]
        if want is not None:
            plain = ipaddress.ip_address(want)
            assert r["t"] == str(plain.ipv4_mapped or plain), r["a"]
    assert "Python" not in df.filter(ip.ip_key(F.col("a")).isNotNull())._jdf.queryExecution().toString()


def test_as_of_and_range_joins(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4), ("a", None, 5)], "k string, t int, _row int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z"), (None, 1, "n")], "k string, u int, v string")
    assert {r["_row"]: r["v"] for r in joins.as_of_join(left, right, ["k"], "t", "u", ["v"]).collect()} == {1: "y", 2: None, 3: None, 4: None, 5: None}
    assert {r["_row"]: r["v"] for r in joins.as_of_join(left, right, ["k"], "t", "u", ["v"], strict=True).collect()} == {1: "x", 2: None, 3: None, 4: None, 5: None}
    points = spark.createDataFrame([(x,) for x in (-1.5, 0.0, 3.0, 7.9, 100.0)], "p double")
    bands = spark.createDataFrame([(0, -2.0, 0.0), (1, 0.0, 50.0), (2, 8.0, 7.0), (3, 7.9, 7.9)], "b int, lo double, hi double")
    got = {(r["p"], r["b"]) for r in joins.range_join(points, bands, F.col("p"), F.col("lo"), F.col("hi"), 4.0).collect()}
    assert got == {(-1.5, 0), (0.0, 0), (0.0, 1), (3.0, 1), (7.9, 1), (7.9, 3)}


def test_stored_postings(spark, lines, tmp_path):
    texts = every_line()
    table = search.PostingsTable.write(lines, f"file://{tmp_path}/p", "id", "line")
    assert table.validate() == {"parts": 1, "n": len(texts), "tokens": sum(len(tokens(t)) for t in texts)}
    want = [(r["id"], round(r["_score"], 9)) for r in search.search(lines, q.Bool(should=(q.Term("line", "oak"), q.Term("line", "elm"))), 20, "id").collect()]
    assert [(r["id"], round(r["score"], 9)) for r in table.search(["oak", "elm"], 20).collect()] == want
    assert sorted(r["id"] for r in table.search(["oak", "elm"], 99, every=True).collect()) == [i for i, t in enumerate(texts) if {"oak", "elm"} <= set(tokens(t))]
    spark.createDataFrame([("x", 99, 1, 1, [0])], "term string, id long, tf long, length int, positions array<int>").write.parquet(f"{tmp_path}/p/postings/part=bad")
    with pytest.raises(ValueError):
        table.validate()


def test_filter_dialects(spark):
    df = spark.createDataFrame([(1, {"n": "9"}), (2, {"n": "10"}), (3, {"n": ""}), (4, {})], "id long, v map<string,string>")
    run = lambda f, dialect="log": ids(df.filter(filters.compile_filter(f, F.col("v"), dialect)))
    assert run(filters.Filter("gt", "n", "9")) == [2]
    assert run(filters.Filter("gt", "n", "1"), "reader") == [1, 2]
    assert run(filters.Filter("is_null", "n")) == [3, 4] and run(filters.Filter("is_null", "n"), "reader") == [4]
    assert run(filters.Filter("neq", "n", "9")) == [2, 3, 4] and run(~filters.Filter("eq", "n", "9")) == [2, 3, 4]
    with pytest.raises(ValueError):
        run(filters.Filter("contains", "n", "1"), "reader")


def test_log(spark, tmp_path):
    log = txlog.TransactionLog(spark, f"file://{tmp_path}/t")
    log.initialise("{}")
    with pytest.raises(ValueError):
        log.initialise("{}")
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(20)], "id long, p int, x double").coalesce(1)
    log.append(df, ["p"], stats=["id"])
    log.append(df.withColumn("id", F.col("id") + 100), ["p"], stats=["id"])
    assert log.current_version() == 2 and log.scan().count() == 40
    assert log.scan(filters.Filter("eq", "p", "1")).count() == 20
    assert log.scan(None, filters.Filter("gt", "id", "100"), {"id": "long"}).count() == 20
    assert log.checkpoint() == 2
    first = txlog.replay(log.actions()).orderBy("path").first()["path"]
    log.remove([first], 1)
    assert txlog.replay(log.actions()).count() == 3 and txlog.replay(log.actions(up_to=2)).count() == 4
    log.skip(first, "busy", 1, 10)
    assert [r["path"] for r in txlog.cooling_down(log.actions(), 5).collect()] == [first]
    assert txlog.changes(log.actions(), 2, 9).count() == 1
    log.delete_where((F.col("id") % 10 != 0) | F.col("id").isNull())
    assert log.scan().filter("id % 10 = 0").count() == 0
    assert log.purge(2**62, dry_run=True) == (2, 0) and log.purge(2**62) == (2, 2)
    stream = streams.log_changes(spark, f"file://{tmp_path}/t").writeStream.format("memory").queryName("log_changes").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("log_changes").filter("action = 'remove'").count() >= 1


def test_log_survives_writers_that_die(spark, tmp_path, monkeypatch):
    log = txlog.TransactionLog(spark, f"file://{tmp_path}/t")
    log.initialise("{}")
    df = spark.createDataFrame([(i, "x" * 200 + str(i)) for i in range(10)], "id long, t string").coalesce(1)
    log.append(df, stats=["id", "t"])
    log.append(df.withColumn("id", F.col("id") + 10), stats=["id", "t"])
    paths = [r["path"] for r in txlog.replay(log.actions()).collect()]
    assert all(len(r["maxValues"]["t"]) == 64 for r in txlog.replay(log.actions()).collect())
    version = log.current_version()

    def dies(*_, **__):
        raise RuntimeError("the writer died")

    with monkeypatch.context() as m:  # before the commit: readers see what was there
        m.setattr(log, "write_once", dies)
        for act in (lambda: log.merge(paths), lambda: log.delete_where(F.col("id") % 2 == 0)):
            with pytest.raises(RuntimeError):
                act()
    assert log.current_version() == version and log.scan().count() == 20
    merged, bad = log.merge(paths, stats=["id"])
    assert (merged, bad) == (version + 1, []) and log.scan().count() == 20  # one version holds the new file and the removes
    assert {r["action"] for r in log.read_version(merged).collect()} == {"add", "remove"}

    with monkeypatch.context() as m:  # a checkpoint that is not published is none
        m.setattr(log, "_create", dies)
        with pytest.raises(RuntimeError):
            log.checkpoint()
    assert log.checkpoint_version() is None and log.scan().count() == 20
    assert log.checkpoint(keep_removed_since=0) == merged == log.checkpoint_version()
    log.delete_where(F.col("id") >= 5)
    assert log.scan().count() == 15 and txlog.tombstones(log.actions()).count() == 3
    assert not log.write_once([{"action": "add", "path": "late"}], merged) and log.scan().count() == 15
    strays = log.collect_garbage(2**62, dry_run=True)
    assert log.collect_garbage(2**62) == strays >= 5 and log.collect_garbage(2**62, dry_run=True) == 0 and log.scan().count() == 15
    (path,) = [r["path"] for r in txlog.replay(log.actions()).collect()]
    log._fs.delete(log._path(path), False)
    with pytest.raises(ValueError):
        log.scan(missing="ignore")


def test_delta(spark, tmp_path):
    where = tmp_path / "d" / "_delta_log"
    where.mkdir(parents=True)
    schema = json.dumps({"type": "struct", "fields": [{"name": "a", "type": "long", "nullable": True, "metadata": {"delta.columnMapping.physicalName": "c1"}}]})
    lines = [
        [{"metaData": {"id": "x", "schemaString": schema, "partitionColumns": ["p"]}}, {"add": {"path": "f1", "partitionValues": {"p": "1"}, "size": 5, "stats": '{"numRecords": 3}'}}],
        [{"add": {"path": "f2", "partitionValues": {"p": "2"}, "size": 6}}],
        [{"remove": {"path": "f1", "deletionTimestamp": 1}}],
    ]
    for v, actions in enumerate(lines):
        (where / f"{v:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    t = delta.DeltaTable(spark, f"file://{tmp_path}/d")
    assert [r["path"] for r in t.files().collect()] == ["f2"] and t.files(1).count() == 2 and t.files(0).first()["num_records"] == 3
    assert t.current_version() == 2 and t.column_mapping() == {"c1": "a"} and t.changes(1, 2).first()["change"] == "remove"
    assert t.files(1, filters.Filter("eq", "p", "2")).count() == 1
    # a checkpoint counts when all of its parts are there
    state = t._actions(2).drop("version").coalesce(1)
    for k in (1, 2):
        state.filter(F.lit(k == 1)).write.parquet(f"{tmp_path}/part{k}")
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(where / f"{2:020d}.checkpoint.{k:010d}.{3:010d}.parquet")
    assert delta.DeltaTable(spark, f"file://{tmp_path}/d").checkpoint_version() is None
    state.filter("false").write.parquet(f"{tmp_path}/part3")
    next((tmp_path / "part3").glob("*.parquet")).rename(where / f"{2:020d}.checkpoint.{3:010d}.{3:010d}.parquet")
    whole = delta.DeltaTable(spark, f"file://{tmp_path}/d")
    assert whole.checkpoint_version() == 2 and len(whole.checkpoint_parts(2)) == 3


def test_hive_files(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "c+d")], "id long, p string").write.partitionBy("p").parquet(f"{tmp_path}/h")
    found = {r["partition_values"]["p"] for r in parquet.files(spark, f"{tmp_path}/h").collect()}
    assert found == {"a b", "c+d"}
    assert parquet.table_info(spark, f"{tmp_path}/h")["partition_columns"] == ["p"]
    assert parquet.widen("bool", "i64") == "i64" and parquet.widen("f64", "bool") == "f64"


def avro(schema, rows):
    """An Avro container file of one block, uncompressed."""

    def number(n):
        n, out = (n << 1) ^ (n >> 63), b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def raw(x):
        data = x.encode() if isinstance(x, str) else x
        return number(len(data)) + data

    def put(kind, x):
        if isinstance(kind, list):
            at = 0 if x is None else next(k for k, t in enumerate(kind) if t != "null")
            return number(at) + (b"" if x is None else put(kind[at], x))
        if kind in ("int", "long"):
            return number(x)
        if kind in ("string", "bytes"):
            return raw(x)
        if kind == "boolean":
            return bytes([x])
        if kind["type"] == "array":
            return (number(len(x)) + b"".join(put(kind["items"], y) for y in x) if x else b"") + number(0)
        return b"".join(put(f["type"], x[f["name"]]) for f in kind["fields"])

    body = b"".join(put(schema, r) for r in rows)
    return b"Obj\x01" + number(1) + raw("avro.schema") + raw(json.dumps(schema)) + number(0) + b"s" * 16 + number(len(rows)) + number(len(body)) + body + b"s" * 16


def record(name, **kinds):
    return {"type": "record", "name": name, "fields": [{"name": n, "type": k} for n, k in kinds.items()]}


def test_iceberg(spark, tmp_path):
    def parquet_file(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return f"file://{next((tmp_path / name).glob('*.parquet'))}"

    first = parquet_file("a", [(1, "x"), (2, "y"), (3, None)], "id long, t string")
    second = parquet_file("b", [(4, "x"), (5, "z")], "id long, t string")
    positions = parquet_file("p", [(first, 0)], "file_path string, pos long")
    values = parquet_file("v", [("x",), (None,)], "t string")
    file_kind = record("data_file", content="int", file_path="string", file_format="string", record_count="long", file_size_in_bytes="long", equality_ids=["null", {"type": "array", "items": "int"}])
    entry_kind = record("manifest_entry", status="int", snapshot_id=["null", "long"], sequence_number=["null", "long"], data_file=file_kind)
    entry = lambda path, content=0, number=None, ids=None, status=1: {"status": status, "snapshot_id": 1, "sequence_number": number, "data_file": {"content": content, "file_path": path, "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1, "equality_ids": ids}}
    list_kind = record("manifest_file", manifest_path="string", sequence_number="long", added_snapshot_id="long", content="int")

    def manifest(name, number, *entries, snapshot=1):
        (tmp_path / name).write_bytes(avro(entry_kind, entries))
        return {"manifest_path": f"file://{tmp_path}/{name}", "sequence_number": number, "added_snapshot_id": snapshot, "content": 0}

    old = [manifest("m1.avro", 1, entry(first)), manifest("m2.avro", 3, entry(second), entry("file:///gone.parquet", status=2))]
    new = [*old, manifest("m3.avro", 2, entry(positions, 1), entry(values, 2, ids=[2]), snapshot=2)]
    for name, manifests in (("l1.avro", old), ("l2.avro", new)):
        (tmp_path / name).write_bytes(avro(list_kind, manifests))
    snapshots = [{"snapshot-id": k, "timestamp-ms": k, "manifest-list": f"file://{tmp_path}/l{k}.avro", "schema-id": 0} for k in (1, 2)]
    schemas = [{"schema-id": 0, "fields": [{"id": 1, "name": "id", "type": "long"}, {"id": 2, "name": "t", "type": "string"}]}]
    (tmp_path / "v2.metadata.json").write_text(json.dumps({"current-snapshot-id": 2, "snapshots": snapshots, "schemas": schemas, "current-schema-id": 0}))
    table = iceberg.IcebergTable(spark, f"file://{tmp_path}/v2.metadata.json")
    assert table.snapshots().count() == 2 and [f["name"] for f in table.schema()] == ["id", "t"]
    assert {(r["content"], r["sequence_number"]) for r in table.files().collect()} == {(0, 1), (0, 3), (1, 2), (2, 2)} and table.files(1).count() == 2
    assert len(table.changed_manifests(1)) == 1
    assert ids(table.scan(1)) == [1, 2, 3, 4, 5]
    # row 1 by its position; of the older file x and null go by value, the younger file keeps its x
    assert ids(table.scan()) == [2, 4, 5]


def test_iceberg_partitions(spark, tmp_path):
    """Deletes stay in their partition, manifests and files that cannot match aren't opened: some of them do not exist."""
    import struct

    def parquet_file(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return f"file://{next((tmp_path / name).glob('*.parquet'))}"

    pair = {"type": "array", "items": record("bound", key="int", value="bytes")}
    entry_kinds = {spec: record("manifest_entry", status="int", sequence_number=["null", "long"], data_file=record("data_file", content="int", file_path="string", file_format="string", record_count="long", file_size_in_bytes="long", partition=record(f"r{spec}", **({"r": "int"} if spec == 0 else {})), equality_ids=["null", {"type": "array", "items": "int"}], lower_bounds=["null", pair], upper_bounds=["null", pair])) for spec in (0, 1)}
    list_kind = record("manifest_file", manifest_path="string", sequence_number="long", added_snapshot_id="long", content="int", partition_spec_id="int", partitions=["null", {"type": "array", "items": record("field_summary", contains_null="boolean", lower_bound=["null", "bytes"], upper_bound=["null", "bytes"])}])
    whole = lambda n: struct.pack("<i", n)

    def entry(path, r=None, content=0, ids=None, low=None, high=None):
        bound = lambda n: None if n is None else [{"key": 1, "value": struct.pack("<q", n)}]
        return {"status": 1, "sequence_number": None, "data_file": {"content": content, "file_path": path, "file_format": "PARQUET", "record_count": 1, "file_size_in_bytes": 1, "partition": {} if r is None else {"r": r}, "equality_ids": ids, "lower_bounds": bound(low), "upper_bounds": bound(high)}}

    def manifest(name, number, entries, spec=0, content=0, span=None, there=True):
        if there:
            (tmp_path / name).write_bytes(avro(entry_kinds[spec], entries))
        return {"manifest_path": f"file://{tmp_path}/{name}", "sequence_number": number, "added_snapshot_id": 1, "content": content, "partition_spec_id": spec, "partitions": None if span is None else [{"contains_null": False, "lower_bound": whole(span[0]), "upper_bound": whole(span[1])}]}

    kind = "id long, t string, r int"
    one, two = parquet_file("one", [(1, "x", 1), (2, "y", 1)], kind), parquet_file("two", [(3, "x", 2), (4, "y", 2), (5, "z", 2)], kind)
    of_one, of_all = parquet_file("d1", [("x",)], "t string"), parquet_file("d2", [("y",)], "t string")
    data = [manifest("m1", 1, [entry(one, 1, low=1, high=2)], span=(1, 1)), manifest("m2", 1, [entry(two, 2, low=3, high=5), entry("file:///no/such/file.parquet", 2, low=90, high=99)], span=(2, 2))]
    deletes = [manifest("m4", 2, [entry(of_one, 1, content=2, ids=[2])], content=1)]
    absent = manifest("m3", 1, [], span=(7, 9), there=False)
    lists = {1: data, 2: [*data, *deletes], 3: [*data, *deletes, manifest("m5", 3, [entry(of_all, content=2, ids=[2])], spec=1, content=1)], 4: [*data, absent]}
    for k, manifests in lists.items():
        (tmp_path / f"l{k}").write_bytes(avro(list_kind, manifests))
    metadata = {"current-snapshot-id": 1, "snapshots": [{"snapshot-id": k, "timestamp-ms": k, "manifest-list": f"file://{tmp_path}/l{k}"} for k in lists], "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "id", "type": "long"}, {"id": 2, "name": "t", "type": "string"}, {"id": 3, "name": "r", "type": "int"}]}],
                "partition-specs": [{"spec-id": 0, "fields": [{"name": "r", "transform": "identity", "source-id": 3, "field-id": 1000}]}, {"spec-id": 1, "fields": []}]}
    (tmp_path / "v.metadata.json").write_text(json.dumps(metadata))
    table, F_ = iceberg.IcebergTable(spark, f"file://{tmp_path}/v.metadata.json"), filters.Filter
    assert ids(table.scan(1, F_("lt", "id", 50))) == [1, 2, 3, 4, 5]  # the bounds of the file that is not there rule it out
    assert ids(table.scan(2, F_("lte", "id", 5))) == [2, 3, 4, 5]  # x goes in its partition only
    assert ids(table.scan(3, F_("lt", "id", 50))) == [3, 5]  # y goes everywhere
    assert ids(table.scan(4, F_("eq", "r", 1))) == [1, 2] and len(table.pruned(F_("eq", "r", 1), 4)) == 1 and len(table.pruned(F_("gte", "r", 2), 4)) == 2
    assert ids(table.scan(1, F_("in", "r", [1, 7]) & F_("gt", "id", 1))) == [2]
    assert iceberg.decode("date", whole(19_845)).isoformat() == "2024-05-02" and iceberg.decode("timestamp", b"12345678") is None and iceberg.decode("string", "é".encode()) == "é"


def test_watermark_drops_late_rows(spark, tmp_path):
    for k, times in enumerate((["2024-01-01 00:01", "2024-01-01 00:02"], ["2024-01-01 03:00"], ["2024-01-01 03:01"], ["2024-01-01 00:03", "2024-01-01 03:02"], ["2024-01-01 09:00"])):
        spark.createDataFrame([(t, k) for t in times], "t string, k int").select(F.to_timestamp("t").alias("ts"), "k").coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        file = next((tmp_path / f"w{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)  # the stream takes them in this order
    raw = spark.readStream.schema("ts timestamp, k int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = streams.windowed(raw, "ts", "1 hour", [], [F.count(F.lit(1)).alias("n")], late="10 minutes")
    running = out.writeStream.format("memory").queryName("late_rows").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    got = {r["window_start"].hour: r["n"] for r in spark.table("late_rows").collect()}
    assert got == {0: 2, 3: 3}  # the row of 00:03 came when the watermark had passed its window, and is dropped; the window of 09:00 is open still


def test_instants_skip_in_any_zone(spark):
    """Bounds carry their offset; those of an unknown zone, and values that do not parse, never skip."""
    bounds = {"utc": ("2024-05-01 00:00:00+00:00", "2024-05-01 12:00:00+00:00"), "none": ("2024-05-01 00:00:00", "2024-05-01 12:00:00"), "odd": ("x", "y")}
    df = spark.createDataFrame([(k, {"t": a}, {"t": b}) for k, (a, b) in bounds.items()], "k string, low map<string,string>, high map<string,string>")
    find = lambda op, v: {r["k"] for r in df.filter(filters.may_match(filters.Filter(op, "t", v), F.col("low"), F.col("high"), {"t": "timestamp"})).collect()}
    assert find("gt", "2024-05-01 14:00:00+02:00") == {"none", "odd"} and find("gte", "2024-05-01 14:00:00+02:00") == {"utc", "none", "odd"}
    assert find("lt", "2024-05-01T02:00:00+02:00") == {"none", "odd"} and find("eq", "never") == {"utc", "none", "odd"}
    for zone, text in (("UTC", "2024-05-01 09:30:00+00:00"), ("America/New_York", "2024-05-01 13:30:00+00:00")):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = spark.createDataFrame([("2024-05-01 09:30:00",)], "s string").select(F.to_timestamp("s").alias("t"))
            assert rows.agg(*filters.bounds_of(rows, "t")).first()["max_t"] == text
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
