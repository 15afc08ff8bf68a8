"""Each operator's query against brute force on a small fixture, and its edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from lodestone.llm import attention_lm, decontamination, html_extraction, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, queries, secrets, sharding, warc

from .conftest import LOWER, corpus, words


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def texts():
    return dict(enumerate(corpus()))


def test_quality_rules(spark, sf):
    got = rows(queries.op5_quality_rules(spark, sf))
    for i, t in texts().items():
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (want[-1] and got[i]["kept"])


def links(sets, percent):
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def shingles(t, n, short=True):
    w = words((t or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w and short else set())


@pytest.mark.parametrize(("n", "percent", "tiny"), [(4, 85, False), (3, 40, True)])
def test_ngram_join(spark, docs, monkeypatch, n, percent, tiny):
    if tiny:
        for name, value in (("BLOCK_NODES", 4), ("BLOCK_GRAMS", 400), ("ANCHORS", 2), ("SMALL_GROUP", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    sets = {i: shingles(t, n) for i, t in texts().items()}
    want = links(sets, percent)
    got = rows(ngram_join.ngram_links(docs, n, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_near_duplicates_keeps_rows_without_id(spark, docs):
    extra = spark.createDataFrame([(None, "a b c d e f g", "en", None, 1)], docs.schema)
    out = ngram_join.near_duplicates(docs.unionByName(extra))
    assert out.columns == docs.columns and out.filter("doc_id is null").count() == 1


def test_decontamination(spark, sf):
    found = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, sf).collect()}
    item = shingles(corpus()[3].split("\n")[1], 5, False)
    want = {(i, 0) for i, t in texts().items() if 10 * len(item & shingles(t, 5, False)) >= 8 * len(item)}
    assert found == want and want
    kept = decontamination.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == set(texts()) - {i for i, _ in want}


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    want = {tuple(r) for r in queries.op3_decontamination(spark, sf).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", 3)
    assert {tuple(r) for r in queries.op3_decontamination(spark, sf).collect()} == want


def test_decontamination_size_partitions(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(k))
    items = spark.createDataFrame([(k, text(k)) for k in (8, 9, 40, 200)], "item_id int, text string")
    parts = decontamination.partitions(decontamination.sketch(items, 5, 0.8, "item_id", "text"))
    assert [p[:2] for p in parts] == [(2, 4), (5, 29), (7, 157)]
    df = spark.createDataFrame([(n,) for n in (3, 4, 30, 500)], "n int")
    got = {r["n"]: r["c"] for r in df.select("n", decontamination.ceiling(df["n"], parts).alias("c")).collect()}
    assert got == {n: max((top for _, need, top, _ in parts if n >= need), default=None) for n in got}
    docs_ = items.withColumnRenamed("item_id", "doc_id")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_contained(docs_, items).collect()} == {(k, k) for k in (8, 9, 40, 200)}


def test_mixing(spark, sf):
    got = rows(queries.op1_entropy_mixing(spark, sf))
    by = collections.defaultdict(list)
    for i, t in texts().items():
        assert got[i]["size"] == len(words(t)) and got[i]["taken"] in (0, got[i]["size"], 2 * got[i]["size"])
        by[got[i]["source"]].append(got[i])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    targets = mixing.targets_by_weight(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2)
    assert math.isclose(sum(targets), 1.5 * sum(sizes))
    for s, size, target in zip(order, sizes, targets, strict=True):
        assert all(r["source_size"] == size and math.isclose(r["target"], target) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= max(10, 0.01 * target)
    assert rows(queries.op1_entropy_mixing(spark, sf)) == got


def test_mix_applied(spark, docs):
    mix = mixing.mix_to_weights(docs)
    copies = {r["doc_id"]: r["copies"] for r in mix.collect()}
    out = mixing.apply_mix(docs, mix)
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter({i: k for i, k in copies.items() if k})


def test_sharding(spark, sf):
    got = rows(queries.op9_sharding(spark, sf))
    for i, t in texts().items():
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    shards = collections.defaultdict(list)
    for i in sorted(got):
        shards[got[i]["shard"]].append(got[i])
    largest = max(r["size"] for r in got.values())
    for k, own in shards.items():
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - sum(r["size"] for r in got.values()) / 8) <= largest
    assert [got[i]["shard"] for i in sorted(got)] == sorted(got[i]["shard"] for i in got)


SECRET = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets(spark):
    cases = [None, "", "token=token: abcdef", "Password : 'abc123' and SECRET=x token==abcdefg", "é AKIA" + "A" * 16 + " x", "f" * 24, "AKIAKIA" + "1" * 20, "api_key = \"k\" apikey:" + "z" * 6, "a\n" * 50 + "ſecret=abcdef"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = rows(secrets.scan_secrets(df))
    for i, t in enumerate(cases):
        b = (t or "").encode()
        at = lambda k, b=b: len(b[:k].decode(errors="ignore"))
        found = [(at(m.start()), 0, at(m.end())) for m in SECRET.finditer(b) if len(m[2]) >= 6]
        found += [(at(m.start()), 1, at(m.end())) for m in re.finditer(rb"AKIA[A-Z0-9]+", b) if len(m[0]) >= 20]
        found += [(at(m.start()), 2, at(m.end())) for m in re.finditer(rb"[0-9a-f]+", b) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(found))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t


def test_warc(spark, sf):
    got = rows(queries.op6_warc(spark, sf), "page_id")
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for i, b in pages.items():
        same = max(k for k, c in pages.items() if c == b)
        revisit = len(b) >= 1000 and same != i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", same) if revisit else ("response", None))
    assert any(r["record_type"] == "revisit" for r in got.values())


def test_warc_payloads_come_back(spark):
    df = spark.createDataFrame([(1, "u\r\nx", "WARC/1.1\r\n\r\n\r\n\r\né" * 200), (2, "v", "WARC/1.1\r\n\r\n\r\n\r\né" * 200), (3, None, None)], "page_id long, url string, html string")
    out = rows(warc.resolve_revisits(warc.read_warc(spark, warc.archive(df)), with_payload=True), "page_id")
    assert out[1]["record_type"] == "revisit" and bytes(out[1]["payload"]).decode() == "WARC/1.1\r\n\r\n\r\n\r\né" * 200 and bytes(out[3]["payload"]) == b""


def test_html(spark, sf):
    got = rows(queries.op4_html_extraction(spark, sf), "page_id")
    body = " ".join(f"word1x{k}" for k in range(300))
    assert got[1]["text"] == f"Head & line\n{body}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[12]["text"] == "" and got[13]["text"] == "" and got[14]["text"] == "small"


def read_host(pages):
    """Texts of pages of one host, as the operator reads them."""
    from lodestone.llm.html import blocks, parse

    streams = [blocks(parse(p)) for p in pages]
    whole = None
    for s in streams:
        own = html_extraction.wrapper_of(s)[0]
        whole = own if whole is None else html_extraction.merge(whole, own)
    reader = html_extraction.Reader(html_extraction.roles_of(whole))
    return whole, [reader.read(s) for s in streams]


def test_wrapper_is_union_free():
    pages = ["<body><div><p>one<p>two</div><div class=x>x</div></body>", "<body><div><p>three</div></body>", "<body><ul><li><b>k</b><p>a</p></li><li><b>k</b><p>b</p></li></ul></body>"]
    H = html_extraction
    p, x, *_ = read_host(pages[:2])[0]
    assert p[H.REPEATED] and p[H.SLOT] == H._VARIES and x[H.OPTIONAL] and not x[H.REPEATED]
    assert [(t[H.PATH][-1], t[H.REPEATED]) for t in read_host(pages[2:])[0]] == [("li", True), ("p", True)]


def test_wrapper_finds_the_article_without_names():
    """Neither article elements nor telling classes: the host's constant texts and menus go, by place and not by a fixed path."""
    text = lambda i, n: " ".join(f"word{i}x{k}" for k in range(n))
    menu = lambda i: "".join(f"<li><a href=/{i}{k}>item {i} {k}</a></li>" for k in range(6))
    page = lambda i: (
        f"<body><div class=c1><ul>{menu(i)}</ul></div><div class=c2>Welcome to this fine place</div><div class=c3>{'<p>Now with pictures</p>' if i % 2 else ''}<h2>Title {i}</h2>"
        f"<p>{text(i, 40)}</p><p>Read <a href=x>more {i}</a> of it {text(i + 90, 9)}</p><h3>Part {i}</h3><p>{text(i + 50, 40)}</p></div><div class=c4>All rights are ours</div></body>"
    )
    _, got = read_host([page(i) for i in range(8)])
    for i, t in enumerate(got):
        assert t == f"Title {i}\n{text(i, 40)}\nRead more {i} of it {text(i + 90, 9)}\nPart {i}\n{text(i + 50, 40)}"


def test_wrapper_keeps_articles_under_doubtful_names_and_copies():
    text = lambda i, n: " ".join(f"word{i}x{k}" for k in range(n))
    _, got = read_host([f"<body><div class='legal-notice'><p>{text(i, 60)}</p></div><div class=related><p>x{i}</p></div></body>" for i in range(4)])
    assert [t.split("\n")[0] for t in got] == [text(i, 60) for i in range(4)]
    _, got = read_host([f"<body><div class=t><p>{text(1, 60)}</p></div><p>{i}</p></body>" for i in range(4)])  # copies of one article are no template
    assert all(text(1, 60) in t for t in got)


def test_html_of_any_depth_and_length():
    import time

    began = time.perf_counter()
    deep = "<div>" * 20_000 + "<p>far down</p>" + "</div>" * 20_000
    mixed = "".join(f"<div class=c{'abc'[k % 3]}>t{k}" for k in range(5_000))
    streams = ["".join("<h2>a</h2>" if (k * k) % n else "<p>b</p>" for k in range(5_000)) for n in (7, 11)]
    unclosed = "<button>" * 20_000 + "<p>end"
    _, got = read_host([deep, mixed, *streams, unclosed])
    assert got[0] == "far down" and got[1].count("\n") == 4_999 and len(got) == 5
    assert time.perf_counter() - began < 60


def test_html_region_keeps_title_lead_and_other_templates(spark):
    text = lambda i, n: " ".join(f"word{i}x{k}" for k in range(n))
    pages = [f"<body><nav>Home</nav><h1>Title {i}</h1><p>Lead {i}</p><div class=text><p>{text(i, 99)}</p><p>{text(i + 50, 99)}</p></div></body>" for i in range(5)]
    pages.append(f"<body><div class=text><p>small</p></div><div class=story><p>{text(9, 200)}</p></div></body>")
    pages.append(f"<body><article><p>aside</p></article><div class=rest><p>{text(8, 200)}</p></div></body>")
    df = spark.createDataFrame([(i, "http://h.example.org/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_articles(df).collect()}
    for i in range(5):
        assert got[i] == f"Title {i}\nLead {i}\n{text(i, 99)}\n{text(i + 50, 99)}"
    assert html_extraction.extract("<h1>T</h1><div class=t><p>a</p><p>b</p></div>", None) == "T\na\nb"
    assert got[5] == f"small\n{text(9, 200)}" and got[6] == f"aside\n{text(8, 200)}"


def test_lm_scoring(spark, sf):
    got = rows(queries.op2_lm_scoring(spark, sf))
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in texts().items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(t), sum(w in c for w in t), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert got[i]["score"] < 0


def test_windows_count_each_token_once():
    import numpy as np

    lengths = np.array([1, 2, attention_lm.WINDOW, attention_lm.WINDOW + 1, 500])
    classes = np.arange(lengths.sum()) % attention_lm.CLASSES
    vectors = np.random.default_rng(1).standard_normal((lengths.sum(), attention_lm.WIDTH)).astype(np.float32)
    for stride in (attention_lm.STRIDE, attention_lm.WINDOW):
        at = np.concatenate([a for _, _, a in attention_lm._batches(vectors, lengths, stride, 4)])
        assert sorted(at.tolist()) == list(range(lengths.sum()))
    p = attention_lm.initial(np.ones(attention_lm.CLASSES))
    p["U"] = np.random.default_rng(2).standard_normal(p["U"].shape).astype(np.float32)
    vectors[np.cumsum(lengths) - 1] = attention_lm.END_VECTOR
    logs = attention_lm.score(p, vectors, classes, lengths)
    alone = attention_lm.score(p, vectors[-500:], classes[-500:], lengths[-1:])
    assert (logs < 0).all() and np.allclose(alone, logs[-500:], atol=1e-4)
    later = vectors.copy()  # what follows a token does not change its score
    later[-200:-1] = 0
    assert np.allclose(attention_lm.score(p, later, classes, lengths)[:-200], logs[:-200], atol=1e-4)


def test_gradient_is_that_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    lengths = np.array([5, 40])
    vectors, classes = rng.standard_normal((45, attention_lm.WIDTH)).astype(np.float32), rng.integers(0, attention_lm.CLASSES, 45)
    p = {k: rng.standard_normal(v.shape) * 0.3 for k, v in attention_lm.initial(np.ones(attention_lm.CLASSES)).items()}
    g, loss = attention_lm.gradient(p, vectors, classes, lengths)
    for name, value in p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-4
        assert math.isclose((attention_lm.gradient(moved, vectors, classes, lengths)[1] - loss) / 1e-4, g[name][at], rel_tol=0.02, abs_tol=0.02), name


def test_lm_block_numbers_do_not_collide():
    from lodestone.llm.lm_scoring import _numbered

    corners = [(t, b) for t in (0, 1, 2**21 - 1) for b in (0, 1, 4096, 2**18 - 1)]
    assert len({_numbered(t, b, 2**24) for t, b in corners}) == len(corners) and max(_numbered(t, b, 1) for t, b in corners) << 24 < 2**63
    for task, block, words in ((2**21, 0, 1), (0, 2**18, 1), (0, 0, 2**24 + 1)):
        with pytest.raises(OverflowError):
            _numbered(task, block, words)


def test_lm_learns_from_context_and_not_from_the_dealing(spark):
    """Two invented languages: the context tells which, so attention beats the unigram base on held-out texts."""
    rng = random.Random(5)
    tongues = [[f"{a}{b}" for a in part for b in ("", "el", "or", "um", "ith", "ana")] for part in (("ka", "vo", "bri", "su"), ("zet", "qui", "mor", "plo"))]
    texts_ = [" ".join(min(rng.choices(tongues[i % 2], k=2)) for _ in range(rng.randint(30, 90))) for i in range(420)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    one, many = (rows(lm_scoring.score_documents(df.repartition(n))) for n in (1, 5))
    held = [r for r in one.values() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert len(held) > 30 and sum(r["score"] - r["base_score"] for r in held) / tokens > 0.15
    assert all(math.isclose(r["score"], many[i]["score"], rel_tol=1e-3) for i, r in one.items())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark):
    base = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(100))
    near, far = base.replace("wbax", "wbay"), " ".join(reversed(base.split()))
    df = spark.createDataFrame([(1, f"{base}\nshort line"), (2, f"{near}\n{far}\nshort line"), (3, base.upper() + "!"), (4, None), (None, far), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in line_dedup.dropped_lines(df).collect()}
    assert got == {1: (2, []), 2: (3, [0, 1]), 3: (1, [0]), 4: (0, []), None: (1, []), 5: (1, [])}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}[2] == "short line"


def test_line_dedup_repeated_rows_and_clashing_names(spark):
    text = "one line of quite some words here\nanother line that has its own words"
    names = ["doc_id", "text", "rid", "_rid", "dropped", "_dropped", "key"]
    df = spark.createDataFrame([(1, text, "a", "b", "c", "d", "e")] * 3 + [(2, text.split("\n")[1] + "\nand a third one that stays as it is", "x", None, None, None, None)], names)
    out = line_dedup.dedup_lines(df)
    assert out.columns == names
    assert sorted((r["doc_id"], r["text"], r["_rid"]) for r in out.collect() if r["doc_id"] == 1) == [(1, "", "b"), (1, "", "b"), (1, text, "b")]
    assert [r["text"] for r in out.filter("doc_id = 2").collect()] == ["and a third one that stays as it is"]


def test_line_dedup_in_crowded_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    tail = "these seven words are shared by all"
    lines = [f"{' '.join(word() for _ in range(30))} {tail}" for _ in range(40)]
    lines += [x.replace(x.split()[3], "other") for x in lines]
    got = line_dedup.dropped_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r["doc_id"] for r in got.filter("n_dropped > 0").collect()} == set(range(40, 80))


def test_line_dedup_takes_short_lines(spark, tmp_path):
    rows_ = [(1, "Les.\n\n* * *\n中文行没有空格"), (2, "les\n \n* * *\n中文行没有空格。\n---"), (3, "Les")]
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["dropped"] for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 2, 3], 3: [0]}


def test_simhash_of_very_long_lines(spark):
    line = " ".join(f"w{k % 997}x{k % 7}" for k in range(11_001))
    df = spark.createDataFrame([(line, 1), (line, 3)], "t string, k int").selectExpr("split(trim(repeat(t || ' ', k)), ' ') as w")
    got = [(r["n"], r["s"]) for r in df.selectExpr("size(w) as n", "w").select("n", line_dedup.simhash(line_dedup._hashes(df["w"])).alias("s")).collect()]
    assert [n for n, _ in got] == [11_001, 33_003] and got[0][1] is not None and got[0][1] == got[1][1]


def test_line_dedup_recall_by_length(spark):
    import random

    rng = random.Random(7)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    pairs, lines = collections.defaultdict(list), []
    for n, letters in ((2, 6), (10, 6), (27, 5), (40, 5), (57, 5), (99, 5)):
        for _ in range(30):
            line = [word(letters) for _ in range(n)]
            other = list(line)
            at = rng.randrange(n)
            other[at] = word(letters) if n >= 10 else other[at][:2] + "q" + other[at][3:]
            x, y = " ".join(line), " ".join(other)
            if x != y and 100 * edit(x, y) <= 10 * len(x):
                pairs[n].append(len(lines) // 2)
            lines += [x, y]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    dropped = {r["doc_id"] for r in line_dedup.dropped_lines(df, min_words=1).filter("n_dropped > 0").collect()}
    assert all(i % 2 for i in dropped)
    for n, own in pairs.items():
        assert len(own) >= 20 and sum(2 * k + 1 in dropped for k in own) >= 0.95 * len(own), n


def test_empty_tables(spark, docs, sf):
    none = docs.limit(0)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(0)
    for out in (
        quality_rules.quality_rules(none), ngram_join.ngram_links(none), decontamination.find_contained(none, bench), decontamination.find_contained(docs, bench.limit(0)), mixing.mix_to_weights(none),
        sharding.shard_by_bytes(none), secrets.scan_secrets(none), warc.resolve_revisits(warc.read_warc(spark, warc.archive(pages))), html_extraction.extract_articles(pages), lm_scoring.score_documents(none), line_dedup.dropped_lines(none),
    ):
        assert out.count() == 0


def test_sketch_of_ngrams_grows_with_the_text(spark):
    from lodestone.llm.ngram_join import _sketch_bits
    from pyspark.sql import functions as F

    texts = lambda k: spark.range(k).select(F.repeat(F.lit("abcdefg "), 1 << 20).alias("text"))  # noqa: E731  8 MB each
    assert _sketch_bits(texts(0)) == 16
    assert [_sketch_bits(texts(k)) for k in (8, 64, 256)] == [20, 23, 25]  # in proportion: at a fixed size the rare ones drown


def test_line_groups_do_not_depend_on_the_size_of_a_block(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    run = ["common", "start", "here"]
    lines = []
    for _ in range(60):
        rest = [word() for _ in range(9)]
        for at in (None, 2, 6):  # three lines of a group differ in one word from each other's first
            lines.append(" ".join(run + [word() if k == at else w for k, w in enumerate(rest)]))
    df = spark.createDataFrame(list(enumerate(rng.sample(lines, len(lines)))), "doc_id long, text string")
    found = lambda: {r["doc_id"] for r in line_dedup.dropped_lines(df).filter("n_dropped > 0").collect()}
    monkeypatch.setattr(line_dedup, "_blocks", lambda norm: F.array(F.xxhash64(F.lit(0))))  # all in one block
    want = found()
    monkeypatch.setattr(line_dedup, "CROWD", 20)
    assert found() == want and len(want) > 50


def test_line_dedup_leaves_no_tables_of_its_phases(spark):
    from lodestone.llm import common

    before = set(common._SCRATCH)
    df = spark.createDataFrame([(1, "one line of quite some words here to keep\nother"), (2, "one line of quite some words here to kept")], "doc_id long, text string")
    assert line_dedup.dropped_lines(df).filter("n_dropped > 0").count() == 1
    left = [p.rsplit("/", 1)[1] for p in common._SCRATCH - before]
    assert not [p for p in left if p.startswith(("lodestone-lines-", "lodestone-line-places", "lodestone-line-texts", "lodestone-line-blocks", "lodestone-line-labels", "lodestone-line-open", "lodestone-line-pairs"))]
    assert sum(p.startswith("lodestone-edges") for p in left) <= 2


def test_line_forms_and_simhashes_are_those_of_the_patterns(spark):
    from pyspark.sql import functions as F

    spaced = ["a  b", "a\tb", " \t \v\f\r a - b -  - c   \n d\t\n", "é٣ ٤½x", "\0 \0a\0\0 b", "    ", " " * 9 + "\n" + " " * 8]
    plain = F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}\s]+", "")
    want = F.regexp_replace(F.regexp_replace(plain, r"\p{N}", "0"), r"[^\S\n ][^\S\n]*|[^\S\n]{2,}", " ")
    assert all(r["x"] == r["y"] for r in spark.createDataFrame([(t,) for t in spaced], "t string").select(line_dedup._bare(F.col("t")).alias("x"), want.alias("y")).collect())
    texts = spark.createDataFrame([(n, " ".join(f"w{k % 97}" for k in range(n))) for n in (1, 2, 127, 128, 5000, 32_767, 32_768)], "key long, norm string")
    both = line_dedup._simhashes(texts).join(texts.select("key", line_dedup.simhash(line_dedup._hashes(F.split("norm", " "))).alias("old")), "key").collect()
    assert len(both) == 7 and all(r["sim"] == r["old"] for r in both)


def test_lines_are_normalised_once(spark):
    rows = spark.createDataFrame([(1, " * * \n\n One, 2  two\n\t\n---"), (2, "one 3 TWO\n* *\n?")], "id long, text string")
    lines = line_dedup._lines(rows, 1)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1  # a filter on forms, or a form named twice, would evaluate it again
    assert {r["norm"]: (r["first"]["id"], r["first"]["line_no"]) for r in lines.collect()} == {"* *": (1, 0), "one 0 two": (1, 2), "---": (1, 4), "?": (2, 2)}
    assert [r["norm"] for r in line_dedup._lines(rows, 2).collect() if r["norm"] in ("---", "?")] == []


def test_lm_numbers_of_words_are_those_of_a_sort():
    import numpy as np

    from lodestone.llm.lm_scoring import _distinct, _used

    for values in (np.random.default_rng(4).integers(-50, 50, 3000), np.zeros(0, np.int64), np.array([-(2**63), 7, -(2**63), 2**63 - 1])):
        unique, first, place, often = _distinct(values)
        u, f, _, k = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        by = np.argsort(unique)
        assert (unique[by] == u).all() and (first[by] == f).all() and (often[by] == k).all() and (unique[place] == values).all()
    places = np.random.default_rng(5).integers(0, 40, 30).astype(np.uint32)
    for got, want in zip(_used(places, 60), np.unique(places, return_inverse=True), strict=True):
        assert (got == want).all()


def test_of_two_groups_of_lines_the_nearest_pair_is_compared_first(spark, monkeypatch):
    base = [f"word{i:03d}" for i in range(30)]
    other = lambda k, n: " ".join([f"other{k:02d}x"] * n + base[n:])
    # groups 100 and 200 link by every pair, 300 and 400 by their second pair only, 500 and 600 not at all
    texts = {100 + k: other(k, 1) for k in range(6)} | {200 + k: other(20 + k, 1) for k in range(6)}
    texts |= {300: other(40, 9), 301: "far " * 30, 400: other(41, 9), 401: other(42, 9), 500: "one two three four", 600: "quite another line"}
    pairs = [(a, b, 100, 200, 5) for a in range(100, 106) for b in range(200, 206)]
    pairs += [(301, 400, 300, 400, 1), (300, 400, 300, 400, 2), (500, 600, 500, 600, 3)]
    old, compared = line_dedup._linked, []

    def linked(pairs, texts):
        compared.append(pairs.count())
        return old(pairs, texts)

    monkeypatch.setattr(line_dedup, "_linked", linked)
    frame = spark.createDataFrame(pairs, "a long, b long, low long, high long, bits int")
    got = line_dedup._merged(frame, spark.createDataFrame(list(texts.items()), "key long, norm string"))
    assert {tuple(r) for r in got.select("root", "_to").collect()} == {(100, 100), (200, 100), (300, 300), (400, 300)}
    assert compared == [3, 1]  # all 39 at once before


@pytest.mark.parametrize("plain", [10, 2000])
def test_edits_by_word_never_link_too_much(spark, monkeypatch, plain):
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "PLAIN", plain)
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        w = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 12))]
        v = ["".join(rng.choice("abcé") if rng.random() < 0.1 else c for c in x) for x in w]
        rows.append((" ".join(w), " ".join(v[: rng.choice([len(v), len(v), max(1, len(v) - 1)])])))
    frame = spark.createDataFrame(rows, "x string, y string")
    exact = F.levenshtein("x", "y") <= F.floor((100 - line_dedup.PERCENT) * F.greatest(F.length("x"), F.length("y")) / 100)
    got = frame.select(line_dedup._similar(F.col("x"), F.col("y")).alias("got"), exact.alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and 10 < sum(r["got"] for r in got) < 110


@pytest.mark.parametrize("scale", [0.3, 40.0])
def test_lm_powers_need_no_shift_where_they_are_small(monkeypatch, scale):
    import numpy as np

    rng = np.random.default_rng(2)
    lengths = np.array([1, 5, 90, 32])
    vectors, classes = rng.standard_normal((lengths.sum(), attention_lm.WIDTH)).astype(np.float32), rng.integers(0, attention_lm.CLASSES, lengths.sum())
    p = {k: (v + scale * 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention_lm.initial(np.ones(attention_lm.CLASSES)).items()}
    needed, old = [], attention_lm._large
    monkeypatch.setattr(attention_lm, "_large", lambda x: needed.append(old(x)) or needed[-1])
    scores, (gradient, loss) = attention_lm.score(p, vectors, classes, lengths), attention_lm.gradient(p, vectors, classes, lengths)
    assert any(needed) == (scale > 1)  # before, always
    monkeypatch.setattr(attention_lm, "_large", lambda x: True)
    assert np.allclose(scores, attention_lm.score(p, vectors, classes, lengths), rtol=1e-5, atol=1e-4) and np.isfinite(scores).all()
    want, also = attention_lm.gradient(p, vectors, classes, lengths)
    assert abs(loss - also) <= 1e-4 * abs(also) and all(np.allclose(gradient[k], want[k], rtol=1e-3, atol=1e-3 * max(1, scale)) for k in want)
