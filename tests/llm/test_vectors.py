"""Vector codes and hard negatives against SQL and brute force, BPE against the library that defines it."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from lodestone.llm import bpe, hard_negatives, oracles, queries, vector_codes
from pyspark.sql import functions as F

KINDS = "vec_id long, embedding array<float>, label int"


def vectors(n=400, dim=16, seed=5):
    """Clusters with copies, ties, odd rows: null and non-finite components, no label, no id, repeated ids."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [float(np.float32(c + rng.gauss(0, 0.3))) for c in centres[i % 6]]
        if i % 9 == 4 and rows:
            v = list(rows[rng.randrange(len(rows))][1] or v)
        rows.append((i, v, i % 4 if i % 13 else None))
    rows[20] = (20, None, 1)
    rows[21] = (21, [None, *rows[22][1][1:]], 1)
    rows[23] = (23, [math.nan, *rows[22][1][1:]], 1)
    rows[24] = (24, [*rows[22][1][1:], -math.inf], None)
    rows[25] = (None, rows[30][1], 2)
    rows[26] = rows[100]
    rows[27] = (27, [0.0] * dim, 2)
    rows[28] = (200, rows[28][1], 3)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(vectors(), KINDS).repartition(5).withColumns({c: F.lit(1) for c in ("label_key", "_label_sum", "row", "anchor", "cells", "score", "v", "id", "code")})


def sql(frame, text):
    con = duckdb.connect()
    con.register("rows", frame.select("vec_id", "embedding", "label").toArrow())
    con.execute("CREATE TABLE embeddings AS SELECT * FROM rows")
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    return Counter(tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall())


def counted(df):
    return Counter(tuple(r[n] for n in sorted(df.columns)) for r in df.collect())


def test_nearest_is_exact_and_filters():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 8, 13):
        entries = rng.integers(-50, 50, (16, width))
        entries[5] = entries[3]
        parts = np.concatenate([rng.integers(-60, 60, (300, width)), entries, np.zeros((2, width), np.int64)])
        every = ((parts[:, None] - entries) ** 2).sum(2)
        code, error = vector_codes.nearest(parts, entries)
        assert (code == every.argmin(1)).all() and (error == every.min(1)).all() and not (code == 5).any()
        big = parts * 1_000_000
        assert (vector_codes.nearest(big, entries * 1_000_000)[0] == every.argmin(1)).all()


@pytest.mark.parametrize("few", [0, 100_000])
def test_codes(odd, monkeypatch, few):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    coded, books = vector_codes.compress(odd)
    out = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))
    assert counted(out) == sql(odd, oracles.oracle_sql()["op11_vector_codes"]) and out.count() == 396


def test_codes_of_few_and_no_rows(spark, odd):
    few = odd.filter("vec_id < 4")
    coded, books = vector_codes.compress(few)
    assert books.shape[1] == 4 and {r["error"] for r in coded.collect()} == {0}
    coded, books = vector_codes.compress(odd.limit(0))
    assert coded.count() == 0 and books.size == 0
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="lengths|divide|range"):
            vector_codes.compress(spark.createDataFrame(rows, KINDS))[0].count()


@pytest.mark.parametrize("sizes", [(256, 16 << 20, 4 << 20), (3, 4000, 300)])
def test_negatives(odd, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "LEAF", sizes[0])
    monkeypatch.setattr(hard_negatives, "CHUNK", sizes[1])
    monkeypatch.setattr(hard_negatives, "BLOCK", sizes[2])
    text = oracles.oracle_sql()["op12_hard_negatives"].replace("% 100", "% 10")
    shifted = odd.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = hard_negatives.mine_hard_negatives(shifted, F.col("vec_id") % 10 == 0)
    want = sql(odd, text)
    assert counted(got) == want and sum(want.values()) > 300
    assert hard_negatives.mine_hard_negatives(shifted.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(shifted, F.lit(False)).columns == got.columns


def test_trees_leave_leaves_out():
    """Directions in three dimensions: an annulus touches few of the leaves, and nothing inside it is missed."""
    rng = np.random.default_rng(2)
    cells = rng.normal(0, 1, (2000, 3))
    cells = (1000 * cells / np.sqrt((cells**2).sum(1))[:, None]).astype(np.int64)
    label = np.arange(2000) % 2
    row = hard_negatives.pack(np.arange(2000), np.arange(2000), label, cells, 64)
    tree = hard_negatives.Stored(dict(zip(("ids", "rows", "labels", "cells", "width", "nodes", "vantage", "leaves", "norm"), row, strict=True)))
    opened = []
    for i in range(0, 2000, 100):
        anchor = cells[i].astype(np.float64)
        low, high = tree.bounds(anchor[None])
        scores = cells @ cells[i]
        positive = sorted(-scores[(label == label[i]) & (np.arange(2000) != i)])[4] * -1
        got = [s for _, _, s in tree.search(anchor, i, label[i], False, [(80 * positive, positive, 0)], 5, low[0], high[0])]
        fits = scores[(label != label[i]) & (100 * scores >= 80 * positive) & (scores <= positive)]
        assert got == sorted(fits.tolist(), reverse=True)[:5]
        room = np.sqrt(max(0, anchor @ anchor + tree.norm**2 - 1.6 * positive))
        opened.append((low[0] <= room).mean())
    assert np.mean(opened) < 0.5


# ---------------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(bpe.tokenizer_bytes())


def agree(library, ours, texts):
    for text, data in zip(texts, ours.encode_all(texts), strict=True):
        want, got = library.encode(text, add_special_tokens=False).ids, np.frombuffer(data, np.int32).tolist()
        assert got == want, repr(text[:200])
        assert ours.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_character(library, ours):
    import unicodedata

    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for lo in range(0, len(known), 4000):
        agree(library, ours, ["".join(known[lo : lo + 4000]), " ".join(known[lo : lo + 4000]), "a1".join(known[lo : lo + 4000])])


def test_random_texts(library, ours):
    rng = random.Random(3)
    pool = [*"abcXYZ'st 019½éΣσß̧́<|>\n\t 한국漢字😀ﬁ̴᷺࢘", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "'ll", "'RE", "the", "ing"]
    agree(library, ours, ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(8000)])
    agree(library, ours, ["ab" * 3000, "x" * 20_000, "the" * 500 + " " + "é" * 700, "", " \n ", "zq" * 32, "q" * 64, "q" * 65])


def test_one_word_and_many_words_merge_alike(ours):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("theinganéß") for _ in range(rng.randint(1, 60))) for _ in range(500)})
    for word, ids in ours.words(words).items():
        raw = word.encode()
        if len(raw) <= bpe.KEPT_LENGTH:
            alone = bpe.merge_word([*(ours.inner[b] for b in raw[:-1]), ours.last[raw[-1]]], ours.rank, ours.merged)
            assert alone == np.frombuffer(ids, np.int32).tolist()


def test_kept_words_start_anew(library, ours, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    for text in ("one two three four five six", "six seven one", "one two"):
        agree(library, ours, [text])
    assert len(ours.kept) <= 9


def test_bpe_table(spark, sf, library, monkeypatch):
    import hashlib

    monkeypatch.setattr(bpe, "SLICE", 500)
    got = {r["doc_id"]: r for r in queries.op13_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_edges(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "x y"), (3, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "id string, text string").withColumns({"ids": F.lit(1), "c0": F.lit(2), "decoded": F.lit("z")})
    coded = bpe.encode(df, id_col="id")
    out = Counter((r["id"], tuple(r["ids"]), r["decoded"]) for r in bpe.decode(coded).collect())
    assert out[("1", (), "")] == 2 and out[(None, (), "")] == 1 and out[("3", (49407,), "<|endoftext|>")] == 1 and sum(out.values()) == 5
    assert bpe.decode(bpe.encode(df.limit(0), id_col="id")).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).first()["decoded"] == ""


def test_other_tokenizer_files_are_errors():
    import public_tokenizers

    with pytest.raises(ValueError, match="lower-casing"):
        bpe.tokenizer_bytes(public_tokenizers.path("byte_bpe_50k.json"))
