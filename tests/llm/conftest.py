import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=160, seed=3):
    """Texts with exact and near copies, a shared passage, nulls, blanks, one long text and repeated lines."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "an", "ti", "ou", "Re", "é") for b in ("on", "er", "st", "", "ing,", "ha.")]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = line(30)
    out = []
    for i in range(n):
        kind = i % 8
        if kind == 1 and out:
            text = out[rng.randrange(len(out))]
        elif kind == 2 and out:
            w = words(out[rng.randrange(len(out))]) or ["x"]
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = line(20) + "\n" + passage + "\n" + line(10)
        else:
            text = "\n".join(line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6)))
        out.append(text)
    out[5], out[6], out[7], out[9] = None, "", " \t\n", " ".join(rng.choice(vocabulary) for _ in range(4000))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 5}", len(t or "")) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def sf(spark, docs, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{where}/documents.parquet")
    passage = corpus()[3].split("\n")[1]
    spark.createDataFrame([(0, passage), (1, None), (2, "too short"), (3, "nothing of this is found in any of the documents at all")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    body = lambda i: "<p>" + " ".join(f"word{i}x{k}" for k in range(300)) + "</p>"
    page = lambda b: f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1>{b}<div class='comments'>bad</div></article><footer>f</footer></body></html>"
    rows = [(i, f"http://h{i % 3}.example.org/{i}", page(body(i % 4))) for i in range(12)] + [(12, None, None), (13, "x", ""), (14, "http://h0.example.org/s", "<p>small")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where
