"""Queries over the driver's tables, one or more for each operator family, with equivalent SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import analysis
from .functions.ip import normal_ip, v4_key
from .operators import aggs, indexed, joins, search
from .operators.rollups import Rollup
from .plans import nodes as q
from .plans.compile import matching
from .plans.parser import parse_query
from .plans.rewrite import with_string_modes
from .sources import datasource, delta, field_ids, filters, parquet
from .sources.tiers import Tiers
from .sources.txlog import TransactionLog, changes, list_files, manifest, prune_manifest, replay, tombstones
from .streaming import keyed, streams

Run = Callable[[SparkSession, str], DataFrame]
RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_RAW = q.Fields(tokenizers={"p_brand": "raw", "p_type": "raw", "source": "raw", "lang": "raw", "url": "raw", "event_type": "raw"})


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _register(name: str, run: Run, sql: str | None = None) -> None:
    RUNS[name] = run
    if sql is not None:
        SQL[name] = sql


def _docs(name: str, query: q.Query | str, where: str) -> None:
    """Ids of the documents that match."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        tree = parse_query(query, ["text"], fields=_RAW) if isinstance(query, str) else query
        return matching(_t(spark, d, "documents"), tree, _RAW).select("doc_id")

    _register(name, run, f"WITH t AS (SELECT *, {_TOK} AS tok FROM documents) SELECT doc_id FROM t WHERE {where}")


_any = lambda cond: f"len(list_filter(tok, lambda t: {cond})) > 0"
_docs("q01_term", q.Term("text", "The"), "list_contains(tok, 'the')")
_docs("q04_term_set", q.TermSet("text", ("pathetic", "worthless")), "list_contains(tok, 'pathetic') OR list_contains(tok, 'worthless')")
_docs("q05_all", q.MatchAll(), "true")
_docs("q06_fuzzy", q.Fuzzy("text", "whith", 1, transposition_cost_one=False), _any("levenshtein(t, 'whith') <= 1"))
_docs("q06_fuzzy_transposition", q.Fuzzy("text", "thta", 1), _any("damerau_levenshtein(t, 'thta') <= 1"))
_docs("q07_phrase", q.Phrase("text", ("of", "the")), "contains(' ' || array_to_string(tok, ' ') || ' ', ' of the ')")
_docs("q07_phrase_slop", q.Phrase("text", ("of", "the"), slop=1), "regexp_matches(' ' || array_to_string(tok, ' ') || ' ', ' of (\\S+ )?the ')")
_docs("q08_bool", q.Bool(must=(q.Term("text", "the"),), should=(q.Term("text", "of"),), must_not=(q.Term("text", "and"),)), "list_contains(tok, 'the') AND NOT list_contains(tok, 'and')")
_docs("q09_dismax_filter", q.DisMax((q.Term("text", "pathetic"), q.Term("text", "der"))), "list_contains(tok, 'pathetic') OR list_contains(tok, 'der')")
_docs("q12_regex", q.Regex("text", "wh[ae]t?"), _any("regexp_full_match(t, 'wh[ae]t?')"))
_docs("q13_wildcard_prefix", q.Wildcard("text", "path*"), _any("starts_with(t, 'path')"))
_docs("q13_wildcard_one", q.Wildcard("text", "w?th"), _any("regexp_full_match(t, 'w.th')"))
_docs("q13a_wildcard_words", q.Wildcard("text", "path* wort*"), f"{_any("starts_with(t, 'path')")} AND {_any("starts_with(t, 'wort')")}")
_docs("q13b_wildcard_unordered", q.Wildcard("text", "*ntion*ingth*"), f"{_any("contains(t, 'ntion')")} AND {_any("contains(t, 'ingth')")}")
_docs("q14_wildcard_lenient", q.Bool(should=(q.Wildcard("nothing", "a*", lenient=True), q.Term("text", "pathetic"))), "list_contains(tok, 'pathetic')")
_docs("s01_term_exact_case", q.Bool(should=(q.Term("text", "The", analyzed=False), q.Term("source", "src1", analyzed=False), q.Term("lang", "de", analyzed=False), q.Term("lang", "FR", analyzed=False))), "list_contains(tok, 'The') OR source = 'src1' OR lang = 'de'")
_docs("s02_minimum_should_match", q.Bool(should=tuple(q.Term("text", t) for t in ("pathetic", "worthless", "the", "of")), minimum_should_match=3), "(list_contains(tok,'pathetic')::int + list_contains(tok,'worthless')::int + list_contains(tok,'the')::int + list_contains(tok,'of')::int) >= 3")
_docs("s06_glob_ordered", q.Wildcard("text", "*th*ble*", ordered=True), _any("regexp_full_match(t, '.*th.*ble.*')"))
_docs("s14_phrase_prefix", q.Phrase("text", ("of", "th"), prefix_last=True), "contains(' ' || array_to_string(tok, ' ') || ' ', ' of th')")
_docs("p01_parse_bool", "the AND NOT and", "list_contains(tok, 'the') AND NOT list_contains(tok, 'and')")
_docs("p01_parse_field_group", 'lang:en AND (pathetic OR "of the")', "lang = 'en' AND (list_contains(tok, 'pathetic') OR contains(' ' || array_to_string(tok, ' ') || ' ', ' of the '))")
_docs("p01_parse_range_exists", "n_chars:[100 TO 500] AND lang:*", "n_chars BETWEEN 100 AND 500 AND lang IS NOT NULL")
_docs("p01_parse_regex", "text:/path.*/", _any("regexp_full_match(t, 'path.*')"))
_docs("p08_single_term_phrase", '"the"', "list_contains(tok, 'the')")
_docs("q16_range_open", q.Range("n_chars", 1000, None, include_lower=False), "n_chars > 1000")
_docs("q18_exists", q.Exists("text"), "text IS NOT NULL")

_register(
    "q16_range_numbers",
    lambda s, d: matching(_t(s, d, "lineitem"), q.Range("l_quantity", 10, 20, True, False, "FLOAT")).select("l_orderkey", "l_linenumber", "l_quantity"),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20",
)
_register(
    "q02_date_range",
    lambda s, d: matching(_t(s, d, "orders"), q.Range("o_orderdate", "1996-01-01", "1996-06-30", type="DATE")).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'",
)
_register(
    "q08_not_exists",
    lambda s, d: matching(_t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left"), ~q.Exists("quality")).select("doc_id"),
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL",
)
for _n, _q, _w in (
    ("q21_json_term", q.JsonTerm("props", "k", "69"), "(props->>'$.k') = '69'"),
    ("q22_json_range", q.JsonRange("props", "k", 10, 20), "CAST(props->>'$.k' AS BIGINT) BETWEEN 10 AND 20"),
    ("q23_json_exists", q.JsonExists("props", "k"), "(props->>'$.k') IS NOT NULL"),
    ("q24_json_leaf", q.JsonExists("props", "k", check_subpaths=False), "(props->>'$.k') IS NOT NULL"),
    ("p01_parse_json_path", "props.k:[5 TO 9]", "CAST(props->>'$.k' AS BIGINT) BETWEEN 5 AND 9"),
):
    _register(
        _n,
        lambda s, d, x=_q: matching(_t(s, d, "events"), parse_query(x, ["props"]) if isinstance(x, str) else x).select("event_id"),
        f"SELECT event_id FROM events WHERE {_w}",
    )

_register(
    "q24_json_leaf_of_objects",
    lambda s, d: matching(_t(s, d, "events").withColumn("props", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": {"x": '), F.col("event_id"), F.lit("}}"))).otherwise(F.col("props"))), q.JsonExists("props", "k", check_subpaths=False)).select("event_id"),
    "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND (props->>'$.k') IS NOT NULL",
)

_IPS = q.Fields(ips=frozenset({"addr"}))
_addr = lambda s, d: _t(s, d, "events").withColumn("addr", F.concat_ws(".", F.lit("10"), (F.col("user_id") % 4).cast("string"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string")))
for _n, _text, _w in (
    ("q03_ip_cidr", "addr:10.1.0.0/16", "user_id % 4 = 1"),
    ("q17_ip_range", "addr:[10.2.0.0 TO 10.2.127.255]", "user_id % 4 = 2 AND user_id % 256 < 128"),
    ("p05_ip_wildcard", "addr:10.3.*", "user_id % 4 = 3"),
    ("h11_ip_or", "addr:10.0.0.0/16 OR addr:10.1.0.0/16", "user_id % 4 IN (0, 1)"),
):
    _register(_n, lambda s, d, x=_text: matching(_addr(s, d), parse_query(x, ["addr"], fields=_IPS), _IPS).select("event_id"), f"SELECT event_id FROM events WHERE {_w}")

# ---------------------------------------------------------------------- ranking
_BM25 = f"""WITH t AS (SELECT doc_id, {_TOK} AS tok FROM documents),
st AS (SELECT count(*) AS n, avg(len(tok)) AS avgl, sum(list_contains(tok,'pathetic')::int) AS d1, sum(list_contains(tok,'the')::int) AS d2 FROM t),
f AS (SELECT doc_id, len(tok) AS l, len(list_filter(tok, lambda x: x = 'pathetic')) AS f1, len(list_filter(tok, lambda x: x = 'the')) AS f2 FROM t),
s AS (SELECT doc_id, ln(1+(n-d1+0.5)/(d1+0.5))*f1*2.2/(f1+1.2*(0.25+0.75*l/avgl)) + ln(1+(n-d2+0.5)/(d2+0.5))*f2*2.2/(f2+1.2*(0.25+0.75*l/avgl)) AS score FROM f, st WHERE f1 > 0 OR f2 > 0)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20"""
_TWO = q.Bool(should=(q.Term("text", "pathetic"), q.Term("text", "the")))
_register("r01_bm25_top_k", lambda s, d: search.search(_t(s, d, "documents"), _TWO, 20, "doc_id").select("doc_id", F.round("_score", 6).alias("score")), _BM25)
_register(
    "q10_boost_const",
    lambda s, d: search.score(_t(s, d, "documents"), q.Bool(should=(q.Boost(q.ConstScore(q.Term("text", "pathetic"), 2.0), 3.0), q.ConstScore(q.Term("text", "the"), 1.0)))).select("doc_id", F.col("_score").alias("score")),
    f"WITH t AS (SELECT doc_id, {_TOK} AS tok FROM documents) SELECT doc_id, list_contains(tok,'pathetic')::int * 6.0::double + list_contains(tok,'the')::int * 1.0::double AS score FROM t WHERE list_contains(tok,'pathetic') OR list_contains(tok,'the')",
)
_register(
    "r02_order_by_field",
    lambda s, d: search.search(_t(s, d, "documents"), q.Term("text", "the"), 10, "doc_id", order_by="n_chars", offset=5).select("doc_id", "n_chars"),
    f"SELECT doc_id, n_chars FROM documents WHERE list_contains({_TOK}, 'the') ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5",
)
_register(
    "r05_by_ids",
    lambda s, d: search.by_ids(_t(s, d, "documents"), [42, 7, 3], "doc_id", ["doc_id", "lang"]),
    "SELECT p.pos::int AS pos, d.doc_id, d.lang FROM documents d JOIN (VALUES (0, 42), (1, 7), (2, 3)) p(pos, id) ON d.doc_id = p.id",
)
_HIT = r"(?i)(^|[^\p{L}\p{N}\x01\x02])(pathetic)($|[^\p{L}\p{N}\x01\x02])"
_register(
    "r12_snippets",
    lambda s, d: search.snippets(matching(_t(s, d, "documents"), q.Term("text", "pathetic")), "text", ["pathetic"]).select("doc_id", "snippet"),
    f"""WITH t AS (SELECT doc_id, text, length(regexp_extract(text, '(?is)^(.*?(?:^|[^\\p{{L}}\\p{{N}}]))pathetic(?:$|[^\\p{{L}}\\p{{N}}])', 1)) + 1 AS hit FROM documents WHERE list_contains({_TOK}, 'pathetic'))
    SELECT doc_id, replace(replace(regexp_replace(regexp_replace(substr(text, greatest(1, hit - 50), 150), '{_HIT}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '{_HIT}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1), '<b>'), chr(2), '</b>') AS snippet FROM t""",  # twice, for hits that share a separator
)
_register(
    "q15_more_like_this",
    lambda s, d: matching(_t(s, d, "documents"), search.more_like_this(_t(s, d, "documents"), "doc_id", 1, "text")).select("doc_id"),
    f"""WITH t AS (SELECT doc_id, {_TOK} AS tok FROM documents), own AS (SELECT w, count(*) AS tf FROM (SELECT unnest(tok) AS w FROM t WHERE doc_id = 1) GROUP BY 1),
    f AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(tok)) AS w FROM t) WHERE w IN (SELECT w FROM own) GROUP BY 1),
    best AS (SELECT list(w) AS ws FROM (SELECT w FROM own JOIN f USING (w) WHERE df >= 2 ORDER BY tf * ln((SELECT count(*) FROM documents) / df) DESC, w LIMIT 10))
    SELECT doc_id FROM t, best WHERE list_has_any(tok, ws)""",
)
_register(
    "q19_explain",
    lambda s, d: search.explain(_t(s, d, "documents"), _TWO).select("doc_id", F.round(F.col("_explain")["text:pathetic"], 6).alias("one"), F.round(F.col("_explain")["text:the"], 6).alias("two")),
    _BM25.split("s AS (SELECT")[0] + """s AS (SELECT doc_id, ln(1+(n-d1+0.5)/(d1+0.5))*f1*2.2/(f1+1.2*(0.25+0.75*l/avgl)) AS one, ln(1+(n-d2+0.5)/(d2+0.5))*f2*2.2/(f2+1.2*(0.25+0.75*l/avgl)) AS two FROM f, st WHERE f1 > 0 OR f2 > 0)
    SELECT doc_id, round(one, 6) AS one, round(two, 6) AS two FROM s""",
)
_register(
    "r16_tokens",
    lambda s, d: _t(s, d, "documents").select(F.explode(analysis.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT unnest({_TOK}) AS token, count(*) AS n FROM documents GROUP BY 1",
)
_register(
    "w08_postings",
    lambda s, d: search.postings(_t(s, d, "benchmark"), "item_id", "text").select("term", "item_id", "tf"),
    f"SELECT term, item_id, count(*) AS tf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2",
)

# ---------------------------------------------------------------------- aggregations
_agg = lambda table, spec, query=None, fields=None: lambda s, d: aggs.aggregate(_t(s, d, table), spec, query, fields)
_register("a01_count", _agg("lineitem", {"value_count": {"field": "l_quantity"}}), "SELECT count(l_quantity) AS value FROM lineitem")
_register("a02_sum", lambda s, d: aggs.aggregate(_t(s, d, "lineitem"), {"sum": {"field": "l_quantity"}}), "SELECT sum(l_quantity) AS value FROM lineitem")
_register("a03_avg", lambda s, d: aggs.aggregate(_t(s, d, "lineitem"), {"avg": {"field": "l_quantity"}}).select(F.round("value", 6).alias("value")), "SELECT round(avg(l_quantity), 6) AS value FROM lineitem")
_register("a04_min", _agg("lineitem", {"min": {"field": "l_discount"}}), "SELECT min(l_discount) AS value FROM lineitem")
_register("a05_max", _agg("lineitem", {"max": {"field": "l_discount"}}), "SELECT max(l_discount) AS value FROM lineitem")
_register(
    "a06_stats",
    lambda s, d: aggs.aggregate(_t(s, d, "lineitem"), {"stats": {"field": "l_quantity"}}).withColumn("avg", F.round("avg", 6)),
    'SELECT count(l_quantity) AS "count", sum(l_quantity) AS "sum", min(l_quantity) AS "min", max(l_quantity) AS "max", round(avg(l_quantity), 6) AS "avg" FROM lineitem',
)
_register("a07_cardinality", _agg("lineitem", {"cardinality": {"field": "l_partkey"}}), "SELECT count(DISTINCT l_partkey) AS value FROM lineitem")
_register(
    "a08_terms",
    lambda s, d: aggs.aggregate(_t(s, d, "lineitem"), {"terms": {"field": "l_returnflag"}, "aggs": {"qty": {"sum": {"field": "l_quantity"}}, "top": {"max": {"field": "l_quantity"}}}}),
    "SELECT l_returnflag AS key, count(*) AS doc_count, sum(l_quantity) AS qty, max(l_quantity) AS top FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
_register(
    "a08_terms_tokens",
    _agg("documents", {"terms": {"field": "text", "size": 25}}, None, q.Fields(tokenizers={"text": "default"})),
    f"SELECT t AS key, count(*) AS doc_count FROM (SELECT unnest(list_distinct({_TOK})) AS t FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
)
_register(
    "a09_terms_options",
    _agg("orders", {"terms": {"field": "o_orderpriority", "exclude": ["5-LOW"], "min_doc_count": 2, "order": {"_key": "desc"}, "size": 3}}),
    "SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1 HAVING count(*) >= 2 ORDER BY 1 DESC LIMIT 3",
)
_register(
    "a10_multi_terms",
    _agg("part", {"multi_terms": {"terms": ["p_brand", "p_type"], "size": 3}, "aggs": {"big": {"max": {"field": "p_size"}}}}),
    """WITH a AS (SELECT p_brand, count(*) c FROM part GROUP BY 1 ORDER BY c DESC, 1 LIMIT 3),
    b AS (SELECT p_brand, p_type, count(*) c, max(p_size)::double AS big, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) r FROM part WHERE p_brand IN (SELECT p_brand FROM a) GROUP BY 1, 2)
    SELECT p_brand AS key_0, p_type AS key_1, c AS doc_count, big FROM b WHERE r <= 3""",
)
_register(
    "a11_histogram",
    _agg("part", {"histogram": {"field": "p_retailprice", "interval": 50, "offset": 7}, "aggs": {"n": {"value_count": {"field": "p_size"}}}}),
    """WITH h AS (SELECT floor((p_retailprice - 7) / 50)::bigint AS k, count(*) AS c, count(p_size) AS n FROM part GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(k) FROM h), (SELECT max(k) FROM h))) AS k)
    SELECT g.k * 50.0::double + 7 AS key, coalesce(c, 0) AS doc_count, n FROM g LEFT JOIN h USING (k)""",
)
_register(
    "a11_histogram_bounds",
    _agg("part", {"histogram": {"field": "p_size", "interval": 10, "hard_bounds": {"min": 5, "max": 30}, "min_doc_count": 1}}),
    "SELECT floor(p_size / 10.0) * 10::double AS key, count(*) AS doc_count FROM part WHERE p_size BETWEEN 5 AND 30 GROUP BY 1",
)
_register(
    "a12_date_histogram",
    _agg("events", {"date_histogram": {"field": "ts", "fixed_interval": "1d", "offset": "6h"}, "aggs": {"u": {"cardinality": {"field": "user_id"}}}}),
    """WITH h AS (SELECT epoch_us(ts) AS m, user_id FROM events), b AS (SELECT m - (((m - 21600000000) % 86400000000) + 86400000000) % 86400000000 AS k, count(*) AS c, count(DISTINCT user_id) AS u FROM h GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(k) FROM b), (SELECT max(k) FROM b), 86400000000)) AS k)
    SELECT make_timestamp(g.k::bigint) AS key, coalesce(c, 0) AS doc_count, u FROM g LEFT JOIN b USING (k)""",
)
_RANGES = {"range": {"field": "l_quantity", "ranges": [{"key": "low", "to": 10}, {"key": "mid", "from": 10, "to": 30}, {"key": "high", "from": 30}, {"key": "none", "from": 1000}]}}
_register(
    "a13_range",
    _agg("lineitem", _RANGES | {"aggs": {"q": {"sum": {"field": "l_quantity"}}}}),
    """WITH r(key, "from", "to") AS (VALUES ('low', NULL::double, 10.0::double), ('mid', 10.0, 30.0), ('high', 30.0, NULL), ('none', 1000.0, NULL))
    SELECT r.key, r."from", r."to", count(l_quantity) AS doc_count, sum(l_quantity) AS q FROM r LEFT JOIN lineitem ON (r."from" IS NULL OR l_quantity >= r."from") AND (r."to" IS NULL OR l_quantity < r."to") GROUP BY 1, 2, 3""",
)
_register(
    "a15_histogram_terms",
    _agg("part", {"histogram": {"field": "p_size", "interval": 10}, "aggs": {"brand": {"terms": {"field": "p_brand", "size": 100}}}}),
    "SELECT floor(p_size / 10.0) * 10::double AS key_0, p_brand AS key_1, count(*) AS doc_count FROM part GROUP BY 1, 2",
)
_register(
    "a16_range_terms",
    _agg("lineitem", _RANGES | {"aggs": {"flag": {"terms": {"field": "l_returnflag"}}}}),
    "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS key_0, l_returnflag AS key_1, count(*) AS doc_count FROM lineitem GROUP BY 1, 2",
)
_register(
    "a17_nested_terms",
    _agg("lineitem", {"terms": {"field": "l_returnflag"}, "aggs": {"s": {"terms": {"field": "l_linestatus"}, "aggs": {"n": {"terms": {"field": "l_linenumber"}, "aggs": {"st": {"stats": {"field": "l_quantity"}}}}}}}}),
    "SELECT l_returnflag AS key_0, l_linestatus AS key_1, l_linenumber::varchar AS key_2, count(*) AS doc_count, count(l_quantity) AS st_count, sum(l_quantity) AS st_sum, min(l_quantity) AS st_min, max(l_quantity) AS st_max, avg(l_quantity) AS st_avg FROM lineitem GROUP BY 1, 2, 3",
)
_register(
    "a18_many_metrics",
    lambda s, d: aggs.aggregate_all(_t(s, d, "lineitem"), {"a": {"sum": {"field": "l_quantity"}}, "b": {"max": {"field": "l_tax"}}, "c": {"value_count": {"field": "l_tax"}}}, q.Range("l_quantity", 10, None))["_metrics"],
    "SELECT sum(l_quantity) AS a, max(l_tax) AS b, count(l_tax) AS c FROM lineitem WHERE l_quantity >= 10",
)
_register(
    "a08_sum_other",
    lambda s, d: aggs.sum_other_doc_count(_t(s, d, "part"), {"terms": {"field": "p_brand", "size": 5}}),
    "SELECT (SELECT count(*) FROM part) - sum(c)::bigint AS value FROM (SELECT count(*) AS c FROM part GROUP BY p_brand ORDER BY c DESC, p_brand LIMIT 5)",
)
_register(
    "a24_filter_agg",
    lambda s, d: aggs.aggregate(_t(s, d, "documents"), {"filter": q.Term("text", "the").to_json(), "aggs": {"m": {"max": {"field": "n_chars"}}}}),
    f"SELECT count(*) AS doc_count, max(n_chars)::double AS m FROM documents WHERE list_contains({_TOK}, 'the')",
)
_register(
    "flagship_search_by_language",
    lambda s, d: aggs.aggregate(_t(s, d, "documents"), {"terms": {"field": "lang"}, "aggs": {"chars": {"sum": {"field": "n_chars"}}}}, q.Bool(must=(q.Term("text", "the"),), must_not=(q.Term("text", "pathetic"),))),
    f"WITH t AS (SELECT *, {_TOK} AS tok FROM documents) SELECT lang AS key, count(*) AS doc_count, sum(n_chars)::double AS chars FROM t WHERE list_contains(tok,'the') AND NOT list_contains(tok,'pathetic') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)

# ---------------------------------------------------------------------- string modes
_AT = r"[\w.]+@[\w.]+\w"


def _modes(s: SparkSession, d: str) -> DataFrame:
    fields = q.Fields(modes={"text": f"text_custom_exactonly:{_AT}"})
    out = with_string_modes(_t(s, d, "documents"), fields)
    return out.filter(F.size("text__uuids") > 0).select("doc_id", F.size("text__uuids").alias("n"), F.element_at("text__uuids", 1).alias("first"))


_register("h04_custom_extract", _modes, r"SELECT doc_id, len(m)::int AS n, m[1] AS first FROM (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z_.]+@[0-9A-Za-z_.]+[0-9A-Za-z_]') AS m FROM documents) WHERE len(m) > 0")
_register(
    "h03_strip",
    lambda s, d: _t(s, d, "pages").select("page_id", analysis.strip_matches(F.col("url"), r"[0-9]+").alias("url")),
    r"SELECT page_id, trim(regexp_replace(regexp_replace(url, '[0-9]+', '', 'g'), '\s+', ' ', 'g')) AS url FROM pages",
)
_register(
    "h01_exact_only",
    lambda s, d: matching(_t(s, d, "part"), q.FullText("p_brand", "Brand#13"), q.Fields(tokenizers={"p_brand": "raw"}, modes={"p_brand": "exact_only"})).select("p_partkey"),
    "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'",
)

# ---------------------------------------------------------------------- log, filters, changes
_LOG_SQL = """WITH a AS (SELECT o_orderkey, o_orderkey % 500 AS path, o_orderkey // 500 AS version, CASE WHEN o_orderkey % 7 = 3 THEN 'remove' ELSE 'add' END AS action, o_orderpriority AS p, o_totalprice AS v FROM orders),
live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) r FROM a) WHERE r = 1 AND action = 'add') """


def _log(s: SparkSession, d: str) -> DataFrame:
    """Orders read as a log: each key is an action on one of 500 paths."""
    o, k = _t(s, d, "orders"), F.col("o_orderkey")
    text = F.col("o_totalprice").cast("string")
    return o.select(
        (k - k % 500).cast("long").alias("_v"), (k % 500).cast("string").alias("path"), F.floor(k / 500).cast("long").alias("version"), F.lit(0).alias("seq"),
        F.when(k % 7 == 3, "remove").otherwise("add").alias("action"), F.create_map(F.lit("p"), F.col("o_orderpriority"), F.lit("k"), (k % 10).cast("string")).alias("partitionValues"),
        F.create_map(F.lit("v"), text).alias("minValues"), F.create_map(F.lit("v"), text).alias("maxValues"),
    )


_paths = lambda df: df.select(F.col("path").cast("long").alias("path"), "version")
_register("t08_replay", lambda s, d: _paths(replay(_log(s, d))), _LOG_SQL + "SELECT path, version FROM live")
_register("t12_list_files", lambda s, d: _paths(list_files(_log(s, d), filters.Filter("eq", "p", "1-URGENT"))), _LOG_SQL + "SELECT path, version FROM live WHERE p = '1-URGENT'")
_register("f03_numeric_compare", lambda s, d: _paths(list_files(_log(s, d), filters.Filter("gte", "k", "5"))), _LOG_SQL + "SELECT path, version FROM live WHERE o_orderkey % 10 >= 5")
_register(
    "f06_not_in",
    lambda s, d: _paths(list_files(_log(s, d), ~filters.Filter("in", "p", ["1-URGENT", "5-LOW"]) & filters.Filter("neq", "missing", "x"))),
    _LOG_SQL + "SELECT path, version FROM live WHERE p NOT IN ('1-URGENT', '5-LOW')",
)
_register("f08_skipping", lambda s, d: _paths(list_files(_log(s, d), None, filters.Filter("gt", "v", "200000"), {"v": "double"})), _LOG_SQL + "SELECT path, version FROM live WHERE v > 200000")
_register(
    "t18_changes",
    lambda s, d: _paths(changes(_log(s, d), 5, 9)),
    _LOG_SQL + "SELECT path, version FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) r, first_value(action) OVER (PARTITION BY path ORDER BY version) f FROM a WHERE version > 5 AND version <= 9) WHERE r = 1 AND NOT (action = 'remove' AND f = 'add')",
)

# ---------------------------------------------------------------------- inherited from Spark: joins, windows, sets, cubes, event time
_register(
    "l_join_semi_anti",
    lambda s, d: _t(s, d, "customer").join(_t(s, d, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(_t(s, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
_register(
    "l_window_rank",
    lambda s, d: _t(s, d, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("r <= 2").select("o_custkey", "o_orderkey", "r"),
    "SELECT o_custkey, o_orderkey, r::int AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r <= 2",
)
_register(
    "l_cube",
    lambda s, d: _t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
_register(
    "l_set_operations",
    lambda s, d: _t(s, d, "orders").select("o_custkey").intersect(_t(s, d, "customer").filter("c_acctbal > 0").select("c_custkey")),
    "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
)


def _as_of(s: SparkSession, d: str) -> DataFrame:
    """For each purchase the last click of its user at or before it."""
    e = _t(s, d, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return joins.as_of_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "click_ts", ["click_id"]).select("event_id", "click_id")


_register(
    "l_as_of",
    _as_of,
    "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
)
_register(
    "l_range_join",
    lambda s, d: joins.range_join(_t(s, d, "part"), _t(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 50 + 900).alias("lo"), (F.col("n_nationkey") * 50 + 960).alias("hi")), F.col("p_retailprice"), F.col("lo"), F.col("hi"), 60).select("p_partkey", "n_nationkey"),
    "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_retailprice BETWEEN n_nationkey * 50 + 900 AND n_nationkey * 50 + 960",
)
_register(
    "l_union_except",
    lambda s, d: _t(s, d, "orders").filter("o_totalprice > 200000").select("o_custkey").union(_t(s, d, "customer").filter("c_acctbal < 0").select("c_custkey")).exceptAll(_t(s, d, "customer").select("c_custkey")),
    "(SELECT o_custkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0) EXCEPT ALL SELECT c_custkey FROM customer",
)
_register(
    "l_rollup",
    lambda s, d: _t(s, d, "lineitem").rollup("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n")),
    "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)",
)
_register(
    "l_grouping_sets",
    lambda s, d: _t(s, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")),
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
)
_register(
    "l_pivot",
    lambda s, d: _t(s, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).select("l_linestatus", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "ANR"]),
    "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1",
)


def _lateral(s: SparkSession, d: str) -> DataFrame:
    """A common table expression and a correlated lateral subquery in Spark SQL."""
    nations, customers = (_t(s, d, t) for t in ("nation", "customer"))
    text = """WITH n AS (SELECT n_nationkey, n_name FROM {nations} WHERE n_regionkey < 3)
    SELECT n.n_name, c.c_custkey FROM n JOIN LATERAL (SELECT c_custkey FROM {customers} WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c"""
    return s.sql(text, nations=nations, customers=customers)


_register(
    "l_lateral_cte",
    _lateral,
    "WITH n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3) SELECT n.n_name, c.c_custkey FROM n, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c",
)
_register(
    "l_event_windows",
    lambda s, d: streams.windowed(_t(s, d, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"),
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
_register(
    "l_sessions",
    lambda s, d: streams.sessions(_t(s, d, "events"), "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")]).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n"),
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
    g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, g""",
)
_register("h08_ip_key", lambda s, d: _addr(s, d).select("event_id", F.hex(v4_key(F.col("addr"))).alias("k")), "SELECT event_id, upper('00000000000000000000ffff0a' || printf('%02x%02x%02x', user_id % 4, user_id % 256, event_id % 256)) AS k FROM events")


# ---------------------------------------------------------------------- dates, addresses, retrieval, postings
_register(
    "q02_date_term",
    lambda s, d: matching(_t(s, d, "orders"), q.Term("o_orderdate", "1996-06-01")).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1996-06-01'",
)
_V6 = lambda s, d: _t(s, d, "events").select("event_id", F.concat(F.lit("2001:db8:"), F.hex(F.col("user_id")), F.lit("::"), F.hex(F.col("event_id") % 65536)).alias("addr"))
_register(
    "x05_ip_text",
    lambda s, d: _V6(s, d).select("event_id", normal_ip(F.col("addr")).alias("t")).unionByName(_addr(s, d).select("event_id", normal_ip(F.col("addr")).alias("t"))),
    """SELECT event_id, CASE WHEN event_id % 65536 = 0 THEN '2001:db8:' || CASE WHEN user_id = 0 THEN ':' ELSE lower(printf('%x', user_id)) || '::' END
      WHEN user_id = 0 THEN '2001:db8::' || printf('%x', event_id % 65536) ELSE '2001:db8:' || printf('%x', user_id) || '::' || printf('%x', event_id % 65536) END AS t FROM events
    UNION ALL SELECT event_id, '10.' || user_id % 4 || '.' || user_id % 256 || '.' || event_id % 256 FROM events""",
)
_register(
    "q17_ipv6_range",
    lambda s, d: matching(_V6(s, d), q.Range("addr", "2001:db8:10::", "2001:db8:20::ffff"), _IPS).select("event_id"),
    "SELECT event_id FROM events WHERE user_id BETWEEN 16 AND 31 OR (user_id = 32)",
)
_register(
    "r09_retrieve_complex",
    lambda s, d: search.retrieve(_t(s, d, "benchmark").withColumn("words", F.split("text", " ")), q.Term("text", "the"), ["item_id", "words"], complex_as_json=True),
    f"SELECT item_id, to_json(string_split(text, ' '))::varchar AS words FROM benchmark WHERE list_contains({_TOK}, 'the')",
)
_register("r14_counts", lambda s, d: search.counts(_t(s, d, "documents")), "SELECT count(*) AS n_docs, 1::bigint AS n_segments FROM documents")
_register(
    "r11_binary_docs",
    lambda s, d: search.binary_docs(_t(s, d, "nation"), "n_nationkey").select("n_nationkey", F.sha1("doc").alias("doc")),
    """SELECT n_nationkey, sha1('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS doc FROM nation""",
)
_register(
    "r03_phrase_score",
    lambda s, d: search.score(_t(s, d, "documents"), q.Phrase("text", ("of", "the"))).select("doc_id", F.round("_score", 6).alias("score")),
    f"""WITH t AS (SELECT doc_id, {_TOK} AS tok FROM documents), st AS (SELECT count(*) AS n, avg(len(tok)) AS avgl, sum(list_contains(tok,'of')::int) AS d1, sum(list_contains(tok,'the')::int) AS d2 FROM t),
    f AS (SELECT doc_id, len(tok) AS l, len(list_filter(list_zip(tok, tok[2:]), lambda x: x[1] = 'of' AND x[2] = 'the')) AS tf FROM t)
    SELECT doc_id, round((ln(1+(n-d1+0.5)/(d1+0.5)) + ln(1+(n-d2+0.5)/(d2+0.5))) * tf * 2.2 / (tf + 1.2*(0.25+0.75*l/avgl)), 6) AS score FROM f, st WHERE tf > 0""",
)


def _folder(s: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"


def _stored_postings(s: SparkSession, d: str) -> DataFrame:
    docs, where = _t(s, d, "documents"), _folder(s)
    table = search.PostingsTable.write(docs.filter("doc_id % 2 = 0"), where, "doc_id", "text", part="even")
    search.PostingsTable.write(docs.filter("doc_id % 2 <> 0"), where, "doc_id", "text", part="odd")
    table.validate()
    return table.merge(where + "-merged").search(["pathetic", "the"], 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_register("w10_stored_postings", _stored_postings, _BM25)


#: Each kind of leaf, by the stored index: name, query, the same in SQL over the words ``tok``.
_BY_INDEX = [
    ("term", q.Term("text", "pathetic"), "list_contains(tok, 'pathetic')"),
    ("set", q.TermSet("text", ("pathetic", "worthless")), "list_has_any(tok, ['pathetic', 'worthless'])"),
    ("fuzzy", q.Fuzzy("text", "patehtic", 1), _any("damerau_levenshtein(t, 'patehtic') <= 1")),
    ("regex", q.Regex("text", "path.*c"), _any("regexp_full_match(t, 'path.*c')")),
    ("prefix", q.Wildcard("text", "wort*"), _any("starts_with(t, 'wort')")),
    ("infix", q.Wildcard("text", "*ntion*ingth*"), f"{_any("contains(t, 'ntion')")} AND {_any("contains(t, 'ingth')")}"),
    ("words", q.Wildcard("text", "path* wort*"), f"{_any("starts_with(t, 'path')")} AND {_any("starts_with(t, 'wort')")}"),
    ("phrase", q.Phrase("text", ("of", "the")), "contains(' ' || array_to_string(tok, ' ') || ' ', ' of the ')"),
    ("phrase_prefix", q.Phrase("text", ("of", "th"), prefix_last=True), "contains(' ' || array_to_string(tok, ' ') || ' ', ' of th')"),
    ("boolean", q.Bool(must=(q.Term("text", "the"), q.Range("n_chars", 100, 3000)), must_not=(q.Term("text", "of"),)), "list_contains(tok, 'the') AND n_chars BETWEEN 100 AND 3000 AND NOT list_contains(tok, 'of')"),
    ("negation", q.Bool(must=(q.MatchAll(),), must_not=(q.Wildcard("text", "*e*"),)), f"NOT coalesce({_any("contains(t, 'e')")}, false)"),
]


def _index(s: SparkSession, d: str) -> indexed.TextIndex:
    """The documents' text in two parts."""
    docs, where = _t(s, d, "documents"), _folder(s)
    indexed.TextIndex.write(docs.filter("doc_id % 2 = 0"), where, "doc_id", ["text"], part="even")
    return indexed.TextIndex.write(docs.filter("doc_id % 2 <> 0"), where, "doc_id", ["text"], part="odd")


def _index_rows(s: SparkSession, d: str) -> DataFrame:
    index, docs = _index(s, d), _t(s, d, "documents")
    return reduce(DataFrame.unionByName, [index.ids(query, docs, "doc_id").select(F.lit(name).alias("leaf"), "doc_id") for name, query, _ in _BY_INDEX])


_register("w08_index_leaves", _index_rows, f"WITH t AS (SELECT *, {_TOK} AS tok FROM documents) " + " UNION ALL ".join(f"SELECT '{name}' AS leaf, doc_id FROM t WHERE {where}" for name, _, where in _BY_INDEX))
_register("r01_index_top_k", lambda s, d: search.search(_t(s, d, "documents"), q.Bool(should=(q.Term("text", "pathetic"), q.Term("text", "the"))), 20, "doc_id", index=_index(s, d)).select("doc_id", F.round("_score", 6).alias("score")), _BM25)


def _months(s: SparkSession, d: str) -> TransactionLog:
    """Each month of the orders as a file's entry: a commit for each year, a state after every second one, a remove between."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    day = lambda c: c("o_orderdate").cast("date").cast("string")
    found = _t(s, d, "orders").groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n"), day(F.min).alias("lo"), day(F.max).alias("hi")).orderBy("m").collect()  # a row for each month
    log = TransactionLog(s, _folder(s))
    log.initialise("o_orderkey long", ["m"])
    years = sorted({r["m"][:4] for r in found})
    for k, year in enumerate(years):
        log.add([{"path": r["m"], "partitionValues": {"m": r["m"]}, "numRecords": r["n"], "minValues": {"o_orderdate": r["lo"]}, "maxValues": {"o_orderdate": r["hi"]}} for r in found if r["m"][:4] == year])
        if k % 2:
            log.checkpoint()
        if k == 1:
            log.remove([f"{year}-06"], 1)
    return log


def _month_files(s: SparkSession, d: str) -> DataFrame:
    found = _months(s, d).list(filters.Filter("gte", "m", "1997-02") & filters.Filter("lte", "m", "1998-01"))
    return found.files.select("path", "numRecords").withColumns({"manifests": F.lit(found.manifests), "opened": F.lit(len(found.opened))})


_MONTHS = "WITH f AS (SELECT strftime(o_orderdate, '%Y-%m') AS path, count(*) AS \"numRecords\", min(o_orderdate)::date AS lo, max(o_orderdate)::date AS hi FROM orders GROUP BY 1), live AS (SELECT * FROM f WHERE path <> '1996-06') "
_register("t07_stored_manifests", _month_files, _MONTHS + "SELECT path, \"numRecords\", 3::int AS manifests, 1::int AS opened FROM live WHERE path BETWEEN '1997-02' AND '1998-01'")


def _month_counts(s: SparkSession, d: str) -> DataFrame:
    """Files at each stage of a listing by dates: the bounds skip what lies outside."""
    found = _months(s, d).list(None, filters.Filter("gte", "o_orderdate", "1996-05-20") & filters.Filter("lt", "o_orderdate", "1997-03-01"), {"o_orderdate": "date"})
    return s.createDataFrame(list(found.counts().items()), "stage string, n long")


_register("t12_listing_counts", _month_counts, _MONTHS + "SELECT 'manifests' AS stage, 3::bigint AS n UNION ALL SELECT 'manifests_opened', 3 UNION ALL SELECT 'entries', count(*) FROM live UNION ALL SELECT 'after_skipping', count(*) FROM live WHERE hi >= DATE '1996-05-20' AND lo < DATE '1997-03-01'")


def _source_rows(s: SparkSession, d: str) -> DataFrame:
    """Orders as a logged table by priority, in two appends around a state and a delete after it, read through the data source."""
    orders = _t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    log = TransactionLog(s, _folder(s))
    log.initialise(", ".join(f"{c} {kind}" for c, kind in orders.dtypes), ["o_orderpriority"])
    log.append(orders.filter("o_orderkey % 2 = 0").coalesce(1), ["o_orderpriority"], stats=["o_orderkey"])
    log.checkpoint()
    log.append(orders.filter("o_orderkey % 2 <> 0").coalesce(1), ["o_orderpriority"], stats=["o_orderkey"])
    log.delete_where(F.col("o_orderkey") % 10 != 0, stats=["o_orderkey"])
    where = filters.Filter("in", "o_orderpriority", ["1-URGENT", "5-LOW"]) & filters.Filter("gte", "o_orderkey", 500)
    return datasource.rows(s, log.root.removesuffix("/_log"), where)


_register("t12_data_source", _source_rows, "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey >= 500 AND o_orderkey % 10 <> 0")


def _skipped_days(s: SparkSession, d: str) -> DataFrame:
    """Events in a file for each day; the instants that bound them leave out the days before and after, whatever the zone of the filter's values."""
    log = TransactionLog(s, _folder(s))
    log.initialise("{}", ["day"])
    log.append(_t(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("day")).repartition("day"), ["day"], stats=["ts"])
    span = filters.Filter("gte", "ts", "2024-01-10T02:00:00+02:00") & filters.Filter("lt", "ts", "2024-01-12 12:00:00Z")
    return log.list(None, span, {"ts": "timestamp"}).files.select(F.col("partitionValues")["day"].alias("day"), "numRecords")


_register("f09_timestamp_skipping", _skipped_days, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS \"numRecords\" FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-10 00:00:00' AND min(ts) < TIMESTAMP '2024-01-12 12:00:00'")


def _rollup(s: SparkSession, d: str) -> Rollup:
    lines, where = _t(s, d, "lineitem"), _folder(s)
    for part in range(3):
        Rollup.write(lines.filter(F.col("l_orderkey") % 3 == part), where, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_partkey"], part=str(part))
    return Rollup(s, where)


_register(
    "a20_rollup_parts",
    lambda s, d: _rollup(s, d).aggregate({"n": {"doc_count": {}}, "top": {"max": {"field": "l_extendedprice"}}, "mean": {"avg": {"field": "l_extendedprice"}}}, ["l_returnflag"]).withColumn("mean", F.round("mean", 4)),
    "SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS top, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1",
)


def _sketch_errors(s: SparkSession, d: str) -> DataFrame:
    """Whether each merged sketch keeps its error: percentiles within 1 % of their rank, distinct values within 3 %."""
    lines, price = _t(s, d, "lineitem"), F.col("l_extendedprice")
    found = _rollup(s, d).aggregate({"p": {"percentiles": {"field": "l_extendedprice", "percents": [5, 50, 95]}}, "parts": {"cardinality": {"field": "l_partkey"}}}, ["l_returnflag"])
    exact = lines.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag").agg(  # a row for each flag
        *[((F.avg((price < F.col(f"p_p{p}")).cast("int")) <= p / 100 + 0.01) & (F.avg((price <= F.col(f"p_p{p}")).cast("int")) >= p / 100 - 0.01)).alias(f"p{p}_within") for p in (5, 50, 95)],
        (F.abs(F.count_distinct("l_partkey") - F.first("parts")) <= 0.03 * F.count_distinct("l_partkey")).alias("distinct_within"),
    )
    return exact.select("l_returnflag", "p5_within", "p50_within", "p95_within", "distinct_within")


_register("a24_sketch_errors", _sketch_errors, "SELECT DISTINCT l_returnflag, true AS p5_within, true AS p50_within, true AS p95_within, true AS distinct_within FROM lineitem")


def _log_table(s: SparkSession, d: str) -> TransactionLog:
    """Nations as a logged table: two appends, a delete, a merge, a checkpoint and one more append."""
    nation = _t(s, d, "nation")
    log = TransactionLog(s, _folder(s))
    log.initialise("{}", ["n_regionkey"])
    log.append(nation.filter("n_nationkey < 10").coalesce(1), ["n_regionkey"], stats=["n_name"])
    log.append(nation.filter("n_nationkey between 10 and 19").coalesce(1), ["n_regionkey"], stats=["n_name"])
    log.delete_where(F.col("n_nationkey") % 4 != 1, stats=["n_name"])
    of_two = [r["path"] for r in list_files(log.actions(), filters.Filter("eq", "n_regionkey", "2")).select("path").orderBy("path").collect()]
    if len(of_two) > 1:
        log.merge(of_two, stats=["n_name"])
    log.checkpoint()
    log.append(nation.filter("n_nationkey >= 20").coalesce(1), ["n_regionkey"], stats=["n_name"])
    return log


_register("w04_log_scan", lambda s, d: _log_table(s, d).scan().select("n_nationkey", "n_name", "n_regionkey"), "SELECT * FROM nation WHERE n_nationkey >= 20 OR n_nationkey % 4 <> 1")
_register(
    "f09_log_skipping",
    lambda s, d: list_files(_log_table(s, d).actions(), filters.Filter("in", "n_regionkey", ["1", "2"]), filters.Filter("gte", "n_name", "NATION_2")).agg(F.sum("numRecords").alias("n"), F.count(F.lit(1)).alias("files")),
    """SELECT sum(n)::bigint AS n, count(*) AS files FROM (SELECT count(*) AS n FROM nation WHERE (n_nationkey >= 20 OR n_nationkey % 4 <> 1) AND n_regionkey IN (1, 2)
      GROUP BY n_regionkey, CASE WHEN n_nationkey >= 20 THEN 2 WHEN n_regionkey = 2 THEN 0 ELSE n_nationkey // 10 END HAVING max(n_name) >= 'NATION_2')""",
)
_register(
    "f07_manifest_pruning",
    lambda s, d: prune_manifest(manifest(_log(s, d), 10), filters.Filter("eq", "p", "1-URGENT")).select(F.element_at("low", "p").alias("p"), "files").groupBy("p").agg(F.sum("files").alias("files")),
    _LOG_SQL + "SELECT p, count(*)::bigint AS files FROM live WHERE p = '1-URGENT' GROUP BY 1",
)
_register(
    "t16_tombstones",
    lambda s, d: _paths(tombstones(_log(s, d))),
    _LOG_SQL + "SELECT path, version FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) r FROM a) WHERE r = 1 AND action = 'remove'",
)


def _delta_files(s: SparkSession, d: str) -> DataFrame:
    """Nations as the files of a Delta log: adds in two versions, then a remove of every fourth."""
    where = _folder(s)
    log = TransactionLog(s, where)
    log.root = f"{where}/_delta_log"
    rows = _t(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    add = lambda r: {"add": {"path": f"{r['n_name']}.parquet", "partitionValues": {"r": str(r["n_regionkey"])}, "size": r["n_nationkey"], "modificationTime": 0, "dataChange": True}}
    first = [{"metaData": {"id": "n", "schemaString": '{"type":"struct","fields":[]}', "partitionColumns": ["r"], "configuration": {}}}, *[add(r) for r in rows[:12]]]
    for v, lines in enumerate((first, [add(r) for r in rows[12:]], [{"remove": {"path": f"{r['n_name']}.parquet", "deletionTimestamp": 1, "dataChange": True}} for r in rows[::4]])):
        log._create(f"{log.root}/{v:020d}.json", "\n".join(json.dumps(x) for x in lines))
    return delta.DeltaTable(s, where).files(partition=filters.Filter("in", "r", ["1", "2", "3"])).select("path", "size")


_register("c01_delta_files", _delta_files, "SELECT n_name || '.parquet' AS path, n_nationkey::bigint AS size FROM nation WHERE n_nationkey % 4 <> 0 AND n_regionkey IN (1, 2, 3)")


def _hive_files(s: SparkSession, d: str) -> DataFrame:
    where = _folder(s)
    _t(s, d, "nation").write.partitionBy("n_regionkey").parquet(where)
    return parquet.files(s, where).select(F.col("partition_values")["n_regionkey"].alias("r")).distinct()


_register("c15_hive_partitions", _hive_files, "SELECT DISTINCT n_regionkey::varchar AS r FROM nation")

# ---------------------------------------------------------------------- keyed state and interval joins on streams
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drained(s: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives when it has read all there is, by way of a written table."""
    where, key = _folder(s), "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, _ROCKS)
    try:
        running = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        s.conf.set(key, before)
    return s.read.schema(stream.schema).parquet(f"{where}/rows")


def _events(s: SparkSession, d: str, stream: bool) -> DataFrame:
    rows = _t(s, d, "events")
    rows = s.readStream.schema(rows.schema).parquet(f"{d}/events.parque[t]") if stream else rows  # a pattern, since a stream takes no single file
    return rows.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


_FIRST = timedelta(minutes=30)
_FIRST_SQL = "SELECT event_id, user_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE ts IS NOT NULL) WHERE (p IS NULL OR ts - p > INTERVAL 30 MINUTE)"
_register("l_first_seen", lambda s, d: keyed.first_seen(_events(s, d, False), "ts", ["user_id"], _FIRST).select("event_id", "user_id"), _FIRST_SQL)
_register(
    "l_first_seen_stream",
    lambda s, d: _drained(s, keyed.first_seen(_events(s, d, True), "ts", ["user_id"], _FIRST, "10 minutes")).select("event_id", "user_id"),
    _FIRST_SQL + " AND ts <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE",  # the rest waits in the state
)


def _pairs(s: SparkSession, d: str, stream: bool) -> DataFrame:
    """Purchases within the hour after a click of the same user."""
    events, late = _events(s, d, stream), "10 minutes" if stream else None
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("clicked"))
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("bought"))
    joined = keyed.interval_join(clicks, bought, ["user_id"], "clicked", "bought", timedelta(0), timedelta(hours=1), late)
    return (_drained(s, joined) if stream else joined).select("user_id", "click", "purchase")


_PAIRS_SQL = "SELECT a.user_id, a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'"
_register("l_interval_join", lambda s, d: _pairs(s, d, False), _PAIRS_SQL)
_register("l_interval_join_stream", lambda s, d: _pairs(s, d, True), _PAIRS_SQL)
_register(
    "t18_transitions",
    lambda s, d: keyed.transitions(_log(s, d).filter("action in ('add', 'remove')")).select("path", "version", "action"),
    _LOG_SQL + "SELECT path::varchar AS path, version, action FROM (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY path ORDER BY version) AS was FROM a WHERE action IN ('add', 'remove')) WHERE action <> was",
)

def _tiered(s: SparkSession, d: str) -> DataFrame:
    """Orders in six appends of a logged table, compacted after every third; the rows by status, and whether few files are left."""
    orders, log = _t(s, d, "orders"), TransactionLog(s, _folder(s))
    log.initialise("{}", ["o_orderstatus"])
    for k in range(6):
        log.append(orders.filter(F.col("o_orderkey") % 6 == k).coalesce(1), ["o_orderstatus"], stats=["o_orderkey"])
        if k % 3 == 2:
            log.compact(Tiers(factor=3))
    files = log.list().files.groupBy(F.col("partitionValues")["o_orderstatus"].alias("o_orderstatus")).agg((F.count(F.lit(1)) <= 2).alias("few"))
    return log.scan().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).join(files, "o_orderstatus")


_register("w07_tiered_merge", _tiered, "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::bigint AS keys, true AS few FROM orders GROUP BY 1")


def _combined(s: SparkSession, d: str) -> DataFrame:
    """A search over an index combined from two, whose parts were merged where they lay."""
    docs, where = _t(s, d, "documents"), _folder(s)
    for k in range(3):
        indexed.TextIndex.write(docs.filter(F.col("doc_id") % 4 == k), f"{where}/a", "doc_id", ["text"], part=str(k))
    indexed.TextIndex(s, f"{where}/a").compact(Tiers(factor=3, floor=1 << 40, ceiling=1 << 50))
    last = indexed.TextIndex.write(docs.filter(F.col("doc_id") % 4 == 3), f"{where}/b", "doc_id", ["text"])
    both = indexed.TextIndex.combine([indexed.TextIndex(s, f"{where}/a"), last], f"{where}/both")
    both.validate()
    return search.search(docs, q.Bool(should=(q.Term("text", "pathetic"), q.Term("text", "the"))), 20, "doc_id", index=both).select("doc_id", F.round("_score", 6).alias("score"))


_register("w11_combined_index", _combined, _BM25)

def _renamed(s: SparkSession, d: str) -> DataFrame:
    """Suppliers stored in two files' schemas, with ids under older names and without ids, and read in today's schema: two columns swapped names, one is within a struct."""
    field = lambda name, kind, k: T.StructField(name, kind, True, {field_ids.ID: k})
    place = lambda a, b: T.StructType([field(a, T.StringType(), 4), field(b, T.StringType(), 5)])
    old = T.StructType([field("key", T.LongType(), 1), field("balance", T.StringType(), 2), field("place", place("street", "phone"), 3)])
    rows = _t(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("balance"), F.struct(F.concat("s_name", F.lit("!")).alias("street"), F.col("s_nationkey").cast("string").alias("phone")).alias("place"))
    where = _folder(s)
    rows.filter("key % 2 = 0").to(old).write.parquet(f"{where}/ids")
    rows.filter("key % 2 <> 0").write.parquet(f"{where}/bare")
    mapping = [{"field-id": 1, "names": ["key"]}, {"field-id": 2, "names": ["balance"]}, {"field-id": 3, "names": ["place"], "fields": [{"field-id": 4, "names": ["street"]}, {"field-id": 5, "names": ["phone"]}]}]
    now = T.StructType([field("balance", T.LongType(), 1), field("key", T.StringType(), 2), field("at", place("label", "nation"), 3), field("place", T.IntegerType(), 6)])
    files = [r["path"] for k in ("ids", "bare") for r in parquet.files(s, f"{where}/{k}").select("path").collect()]
    return field_ids.read(s, files, now, mapping).select("balance", "key", F.col("at.label").alias("label"), F.col("at.nation").alias("nation"), "place")


_register("c16_field_ids", _renamed, "SELECT s_suppkey::bigint AS balance, s_name AS key, s_name || '!' AS label, s_nationkey::varchar AS nation, NULL::int AS place FROM supplier")

# ---------------------------------------------------------------------- aggregations of several levels, arrays, pages of groups
_register(
    "a14_outer_metrics",
    _agg("lineitem", {"terms": {"field": "l_returnflag"}, "aggs": {"qty": {"sum": {"field": "l_quantity"}}, "s": {"terms": {"field": "l_linestatus"}, "aggs": {"top": {"max": {"field": "l_quantity"}}}}}}),
    """WITH o AS (SELECT l_returnflag AS key_0, count(*) AS doc_count_0, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
    SELECT key_0, l_linestatus AS key_1, count(*) AS doc_count, max(l_quantity) AS top, any_value(doc_count_0) AS doc_count_0, any_value(qty) AS qty FROM lineitem JOIN o ON key_0 = l_returnflag GROUP BY 1, 2""",
)
_register(
    "a14_sibling_buckets",
    lambda s, d: aggs.aggregate_each(_t(s, d, "orders"), {"terms": {"field": "o_orderstatus"}, "aggs": {"p": {"terms": {"field": "o_orderpriority"}}, "h": {"histogram": {"field": "o_totalprice", "interval": 100000}}}})["agg>p"],
    "SELECT o_orderstatus AS key_0, o_orderpriority AS key_1, count(*) AS doc_count FROM orders GROUP BY 1, 2",
)
_register(
    "a01_array_values",
    lambda s, d: aggs.aggregate(_t(s, d, "benchmark").withColumn("lengths", F.transform(F.split("text", " "), lambda w: F.length(w))), {"stats": {"field": "lengths"}}).withColumn("avg", F.round("avg", 6)),
    """SELECT count(x) AS "count", sum(x)::double AS "sum", min(x)::double AS "min", max(x)::double AS "max", round(avg(x), 6) AS "avg" FROM (SELECT unnest(list_transform(string_split(text, ' '), lambda w: length(w))) AS x FROM benchmark)""",
)
_register(
    "a24_composite",
    _agg("lineitem", {"composite": {"size": 7, "sources": [{"flag": {"terms": {"field": "l_returnflag"}}}, {"qty": {"histogram": {"field": "l_quantity", "interval": 10}}}], "after": {"flag": "A", "qty": 20.0}}, "aggs": {"tax": {"max": {"field": "l_tax"}}}}),
    "SELECT l_returnflag AS flag, floor(l_quantity / 10) * 10 AS qty, count(*) AS doc_count, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2 HAVING l_returnflag > 'A' OR (l_returnflag = 'A' AND floor(l_quantity / 10) * 10 > 20) ORDER BY 1, 2 LIMIT 7",
)
_register(
    "a24_top_hits",
    lambda s, d: aggs.aggregate(_t(s, d, "orders"), {"terms": {"field": "o_orderpriority"}, "aggs": {"best": {"top_hits": {"size": 2, "sort": [{"o_totalprice": "desc"}], "_source": ["o_orderkey"]}}}}).select("key", "doc_count", F.posexplode("best").alias("pos", "hit")).select("key", "doc_count", "pos", "hit.o_orderkey"),
    "SELECT key, doc_count, r::int AS pos, o_orderkey FROM (SELECT o_orderpriority AS key, o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS doc_count, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r FROM orders) WHERE r < 2",
)
_register(
    "a09_terms_include_missing",
    lambda s, d: aggs.aggregate(_t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left"), {"terms": {"field": "quality", "missing": "none", "include": ["none", "1"]}}),
    "SELECT coalesce(quality::varchar, 'none') AS key, count(*) AS doc_count FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality::varchar, 'none') IN ('none', '1') GROUP BY 1",
)
_register(
    "a24_extended_stats",
    lambda s, d: aggs.aggregate(_t(s, d, "lineitem"), {"terms": {"field": "l_returnflag"}, "aggs": {"q": {"extended_stats": {"field": "l_quantity"}}}}).select("key", F.round("q_variance", 6).alias("variance"), F.round("q_std_deviation", 6).alias("deviation")),
    "SELECT l_returnflag AS key, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1",
)


def queries() -> dict[str, Run]:
    return dict(RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
