"""The pipeline's stages, one after another, against brute force."""

import collections

import corpus_pipeline

from .conftest import corpus
from .test_operators import links, rows, shingles


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == names
        seen.append(collections.Counter(r["doc_id"] for r in docs.collect()))
    texts = dict(enumerate(corpus()))
    good, unique, clean, mixed, dealt = seen
    assert set(good) <= set(texts) and good
    roots = links({i: shingles(texts[i], 5) for i in good}, 80)
    assert set(unique) == set(roots.values())
    item = shingles(corpus()[3].split("\n")[1], 5, False)
    assert set(clean) == {i for i in unique if 10 * len(item & shingles(texts[i], 5, False)) < 8 * len(item)}
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    assert dealt == mixed
    assert rows(corpus_pipeline.run(spark, sf)).keys() == dealt.keys()
