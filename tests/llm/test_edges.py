"""What every operator and stage does with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections

import corpus_pipeline
import pytest
from lodestone.llm import decontamination, html_extraction, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, secrets, sharding, warc
from pyspark.sql import functions as F

PASSAGE = "a passage of the benchmark that some of the documents hold from its first word to the last one of them"
LONG = " ".join(f"word{k % 3000}x" for k in range(6000))
BODY = "the words of this text and that one are all in it for us to be as on at or by this is from which you have not was with "
#: Names that the operators use for columns of their own.
CLASHING = ["_key", "_gone", "_n", "_copy", "_copies", "_rows", "__t", "__w", "__l", "_rid", "_dropped", "key", "id", "_alike", "_whole", "_words", "_lines", "_doc", "_text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Two equal rows, two rows of one id, rows without an id, a source, a text, blank texts, a long one, ties in size."""
    texts = [(1, BODY * 4), (1, BODY * 4), (2, BODY + PASSAGE), (2, LONG), (None, BODY * 4), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, BODY + "\n" + BODY), (7, "one"), (8, "\u0000 \ud55c\uad6d\uc5b4 \U0001f600")]
    rows = [(i, t, None if k % 3 == 0 else "s", "en" if k % 2 else None, k) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    return df.select("*", *[F.lit(name).alias(name) for name in CLASHING])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, PASSAGE), (0, PASSAGE), (1, None), (2, ""), (None, "of no id but of more than five words"), (3, "\ud55c\uad6d\uc5b4")], "item_id long, text string")


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.collect())


def whole(df, out):
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r[name] == name for r in rows for name in CLASHING)
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_rules(odd):
    out = quality_rules.quality_rules(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and ids(out) == ids(odd)
    assert {r["doc_id"] for r in out.filter("n_words = 0").collect()} >= {None, 3, 4, 5}


def test_near_copies(odd):
    found = ngram_join.ngram_links(odd)
    assert ids(found) == ids(odd) and found.filter("doc_id is null and component_id is not null").count() == 0
    kept = whole(odd, ngram_join.near_duplicates(odd))
    assert kept[(None, BODY * 4)] == 1 and kept[(1, BODY * 4)] == 2  # rows of one id are one document


def test_contained_items(odd, bench):
    found = decontamination.find_contained(odd, bench)
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in found.collect()) == {(2, 0): 1, (8, 3): 1}  # a short item is held whole
    kept = whole(odd, decontamination.decontaminate(odd, bench))
    assert (2, BODY + PASSAGE) not in kept and (2, LONG) in kept and sum(kept.values()) == 10
    assert decontamination.decontaminate(odd.limit(0), bench).count() == 0 and sum(whole(odd, decontamination.decontaminate(odd, bench.limit(0))).values()) == 12


@pytest.mark.parametrize("most", [100_000, 0])
def test_mix(odd, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    mix = mixing.mix_to_weights(odd)
    rows = mix.collect()
    assert ids(mix) == ids(odd)
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    largest = max(r["size"] for r in rows)
    assert all(abs(taken[r["source"]] - r["target"]) <= largest for r in rows)
    copies = collections.Counter()
    for r in rows:
        copies[r["row_key"]] += r["copies"]
    assert sum(whole(odd, mixing.apply_mix(odd, mix)).values()) == sum(copies.values())
    assert mixing.mix_to_weights(odd.limit(0)).count() == 0


def test_shards(odd):
    out = sharding.shard_by_bytes(odd, 3)
    assert ids(out) == ids(odd)
    for s in range(3):
        slots = sorted(r["slot"] for r in out.filter(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))


def test_secrets_and_lines(odd):
    assert ids(secrets.scan_secrets(odd.select("doc_id", "text"))) == ids(odd)
    kept = whole(odd, line_dedup.dedup_lines(odd, min_words=1))
    assert sum(kept.values()) == 12 and kept[(None, BODY * 4)] == 1 and kept[(1, "")] == 2 and kept[(3, None)] == 1


def test_scores(odd):
    out = lm_scoring.score_documents(odd)
    rows = out.collect()
    assert ids(out) == ids(odd) and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] == 2) == [6001, len((BODY + PASSAGE).split()) + 1][::-1] and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert len({(round(r["score"], 2), round(r["base_score"], 6)) for r in rows if r["n_tokens"] == len((BODY * 4).split()) + 1}) == 1


def test_pages(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    rows = [(1, "http://a/1", deep), (1, "http://a/1", deep), (2, None, "<p>no host</p>"), (3, "http://a/3", None), (None, "x", "<p>" + LONG), (4, "http://a/4", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r["page_id"], r["text"]) for r in html_extraction.extract_articles(pages).collect())
    assert got == {(1, "deep"): 2, (2, "no host"): 1, (3, ""): 1, (None, LONG): 1, (4, ""): 1}
    back = warc.resolve_revisits(warc.read_warc(spark, warc.archive(pages)), with_payload=True).collect()
    assert collections.Counter((r["page_id"], bytes(r["payload"] or b"").decode()) for r in back) == collections.Counter((i, h or "") for i, _, h in rows)


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 4000)
    pages = spark.createDataFrame([(i, "u", f"{i}" * 900) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    where = warc.archive(pages)
    assert spark.read.format("binaryFile").load(where).count() >= 4 and warc.read_warc(spark, where).count() == 12


def test_stages(spark, odd, bench, tmp_path):
    """Stages take any table of documents: rejected documents go, all columns stay, empty tables stay empty."""
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        assert ids(out) and not set(ids(out)) - set(ids(odd)), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
