"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size (powers of two of their shingle count q). An item's sketch is its m smallest MinHash values,
m = q - ceil(t * q) + 1: a document that contains a share t of the item's shingles holds one of these m at least, so the
search misses nothing. Each size partition has a ceiling, its largest sketch value, and a least size, its smallest t * q; a document
probes only with shingles up to the ceilings of the partitions that its own size allows, and documents with fewer shingles than t * q are dropped before the check. A pair that the sketch finds
is verified on the whole shingle sets.

Only built-in functions run. Sketches go to the documents in blocks of a bounded number of rows, each broadcast; the search shuffles no
text (taking the found documents out of a table does), and a passage that very many documents share costs each of them its own check and no more.

Defined results: null or blank texts hold nothing, and null or blank items are held by nothing; an item of fewer words than a shingle is one
shingle of its own length, held by what holds it whole; repeated items with one id are one item, the union of their shingles;
repeated documents are found once in each pair and all taken out; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, words

#: Rows of a broadcast block of sketches: about 60 MB with their items' shingles at 64 shingles an item.
BLOCK_ROWS = 100_000


def shingle_hashes(text: Column, n: int, short: tuple[int, ...] = ()) -> Column:
    """Hashes of the text's windows of ``n`` words, in lower case, with repeats, and of its windows of each length of ``short``."""

    def windows(w: Column, k: int) -> Column:
        own = [F.lit(k)] if k < n else []
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*own, *[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(each)

    return let(words(F.lower(text)), lambda w: F.concat(windows(w, n), *[windows(w, k) for k in short]) if short else windows(w, n))


def item_hashes(text: Column, n: int) -> Column:
    """An item's shingles; one of fewer words is a single shingle of its own length."""
    whole = lambda w, k: F.array(F.xxhash64(F.lit(k), *[F.get(w, F.lit(j)) for j in range(k)]))

    def of(w: Column) -> Column:
        out = shingle_hashes(F.array_join(w, " "), n)
        for k in range(1, n):
            out = F.when(F.size(w) == k, whole(w, k)).otherwise(out)
        return out

    return let(words(F.lower(text)), of)


def sketch(items: DataFrame, n: int, threshold: float, item_id: str, text: str) -> DataFrame:
    """A row for each sketch value of each item: ``item, size_class, need, q, hashes, value``."""
    sets = (
        items.select(F.col(item_id).alias("item"), F.explode(item_hashes(F.col(text), n)).alias("h"))
        .groupBy("item")
        .agg(F.sort_array(F.collect_set("h")).alias("hashes"))
        .withColumn("q", F.size("hashes"))
        .withColumn("need", F.ceil(F.lit(threshold).cast("decimal(10,6)") * F.col("q")).cast("int"))
    )
    values = sets.withColumn("size_class", F.floor(F.log2("q")).cast("int")).withColumn(
        "value", F.explode(F.slice("hashes", F.lit(1), F.col("q") - F.col("need") + 1))
    )
    return values


def partitions(sketches: DataFrame) -> list[tuple[int, int, int, int]]:
    """``size_class, need, top, rows`` of each size partition (31 at most): its least size, its ceiling and its sketch rows."""
    found = sketches.groupBy("size_class").agg(F.min("need").alias("need"), F.max("value").alias("top"), F.count(F.lit(1)).alias("rows"))
    return sorted(tuple(r) for r in found.collect())


def ceiling(size: Column, parts: list[tuple]) -> Column:
    """The highest ceiling of the partitions that a document of ``size`` shingles can hold items of; null if there is none."""
    none = F.lit(None).cast("long")
    return F.greatest(none, none, *[F.when(size >= need, F.lit(top)) for _, need, top, *_ in parts])


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, item, n_shared, n_item_shingles, containment`` and the columns of ``keep``: one row a pair, containment >= threshold."""
    sketches = sketch(items, n, threshold, item_id, item_text)
    parts = partitions(sketches)
    blocks = max(1, -(-sum(p[3] for p in parts) // BLOCK_ROWS))
    sizes = F.size(words(F.lower(F.col(item_text))))
    short = tuple(sorted(r[0] for r in items.select(sizes.alias("k")).filter(F.col("k").between(1, n - 1)).distinct().collect()))  # n - 1 rows at most
    h = F.filter(shingle_hashes(F.col(text), n, short), lambda x: F.lit(True))
    base = docs.select(F.col(id_col).alias("_id"), *[F.col(c) for c in keep], h.alias("_h"))
    low = F.explode(F.array_distinct(let(ceiling(F.size("_h"), parts), lambda top: F.filter("_h", lambda x: x <= top))))
    probes = base.withColumn("_v", low)
    found = []
    for k in range(blocks):
        block = sketches.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else sketches
        hit = probes.join(F.broadcast(block), (F.col("_v") == F.col("value")) & (F.size("_h") >= F.col("need")))
        shared = F.size(F.array_intersect("hashes", "_h"))
        found.append(hit.withColumn("n_shared", shared).filter(F.col("n_shared") >= F.col("need")).drop("_h", "hashes", "value", "_v", "need", "size_class"))
    out = reduce(DataFrame.unionByName, found).distinct()
    return out.select(
        F.col("_id").alias(id_col),
        *keep,
        F.col("item").alias(item_id),
        F.col("n_shared").cast("long"),
        F.col("q").cast("long").alias("n_item_shingles"),
        (F.col("n_shared") / F.col("q")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay."""
    key, gone = fresh(docs, "key", "gone")
    found = find_contained(docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(id_col, text).alias("_key")), items, n, threshold, "_doc", "_text", item_id, item_text, ("_key",))
    hits = found.select(F.col("_key").alias(gone)).distinct()
    out = docs.withColumn(key, F.xxhash64(id_col, text)).join(hits, F.col(key) == F.col(gone), "left_anti")
    return out.select(docs.columns)
