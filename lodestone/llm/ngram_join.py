"""N-gram Jaccard self-join by prefix trees: which documents are linked by J(a, b) >= t over their word n-gram sets.

1. Every text becomes its set of n-gram hashes; equal sets become one node.
2. In an order common to all nodes, rare n-grams first, a link implies a common n-gram among the first
   ``n - ceil(t * n) + 1`` of both sets. Frequencies come from one sketch, which grows with the text; any order is right, this one keeps
   passages that many documents share out of the prefixes.
3. Nodes that share a prefix n-gram are candidates; components of candidates are cut into blocks of a bounded number of nodes
   and n-grams. In a block the ordered sets are stored in a trie and all sets traverse it together, sharing the overlap
   counted so far, leaving subtrees whose remaining length cannot reach t, and skipping what is linked already.
4. A component of several blocks is finished by two more rounds: against anchors of its first block, and then whatever is
   not yet in one group. There, pairs that meet in small prefix groups are compared as pairs; of large prefix groups, what
   is outside the component's main group is compared by blocks with all that it meets. So no link between two groups is
   missed, and no large group is expanded into its pairs.

Defined results: a text of fewer words than n is one n-gram, the whole sequence; null and blank texts have no n-grams and link
with nothing, nor do rows without an id; rows of one id are one document to the links; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, release
from .components import connected_components
from .shingles import buffers, mix, shingles, word_hashes, word_spans

#: The frequency sketch has a bucket for so many bytes of text, and 2 to these powers at least and at most; fewer could not tell rare n-grams from common ones.
_BUCKET_BYTES, _SKETCH_BITS = 128, (16, 26)
_SLICE_BITS = 16
#: Nodes and n-grams of a block: they bound what a task holds, not what is compared.
BLOCK_NODES, BLOCK_GRAMS, ANCHORS = 256, 600_000, 64
#: Prefix n-grams of more nodes link them as a star and not pair by pair.
SMALL_GROUP = 8


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(texts)
    starts, ends, before = word_spans(data, offsets)
    return shingles(word_hashes(data, starts, ends), before, n)


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _nodes(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; sets are ascending, so the digest mixes a sum and the size."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + np.uint64(0x51ED270B)), out=sums[1:])
    return mix(sums[before[1:]] - sums[before[:-1]] + np.diff(before).astype(np.uint64)).view(np.int64)


def _sketch_bits(texts: DataFrame) -> int:
    """Buckets of the sketch, as a power of two, in proportion to the text."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max((size // _BUCKET_BYTES).bit_length(), _SKETCH_BITS[0]), _SKETCH_BITS[1])


def _profile(n: int, bits: int):
    """Per document its set's size and node; per task the sketch of its documents' n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for whole in batches:
            for batch in _pieces(whole):
                values, before = _sets(batch.column(1), n)
                np.add.at(counts, (values >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(before)), pa.array(_nodes(values, before)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                    names=["id", "n", "node", "slice", "counts"],
                )
        for k, part in enumerate(np.split(counts, len(counts) >> _SLICE_BITS)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                packed = zlib.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # low bytes first: the others are nearly all zero
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=["id", "n", "node", "slice", "counts"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of the tasks' counts of a slice, as a byte each: steps of about 6 percent are as good an order as the counts."""
    total = np.zeros(1 << _SLICE_BITS, np.int64)
    for x in pdf["counts"]:
        total += np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    level = np.minimum(12 * np.log2(1 + total), 255).astype(np.uint8)
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [zlib.compress(level.tobytes(), 1)]})


def _prefixes(n: int, percent: int, frequency: np.ndarray):
    """The rarest n-grams of each set, as many as a link needs; a set met before in the task is not repeated."""
    bits = len(frequency).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in _pieces(whole):
                values, before = _sets(batch.column(1), n)
                nodes, sizes = _nodes(values, before), np.diff(before)
                usable = np.asarray(batch.column(0).is_valid()) & (sizes > 0)
                fresh = np.array([u and not (x in seen or seen.add(x)) for u, x in zip(usable.tolist(), nodes.tolist(), strict=True)], bool)
                row = np.repeat(np.arange(len(sizes)), sizes)
                rank = frequency[(values >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((values, rank, row))
                place = np.arange(len(values)) - before[:-1][row]
                longest = sizes - -(-sizes * percent // 100) + 1
                take = (place < longest[row]) & fresh[row]
                at = row[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[order][take].view(np.int64)), pa.array(nodes[at]), pa.array(sizes[at].astype(np.int32)), pa.array(place[take].astype(np.int32))],
                    names=["gram", "node", "n", "place"],
                )

    return run


class Trie:
    """Ordered sets as a radix tree: an edge is a run of n-grams that all sets below it share."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.lcp = [0] * len(sets)
        for k in range(1, len(sets)):
            a, b = self.sets[k - 1], self.sets[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.lcp[k] = int(differ[0]) if len(differ) else m

    def children(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """Of the rows low..high-1, alike up to ``depth``: sub-ranges and the depth up to which each is alike."""
        cuts = [low] + [k for k in range(low + 1, high) if self.lcp[k] <= depth] + [high]
        return [(a, b, len(self.sets[a]) if b - a == 1 else min(self.lcp[a + 1 : b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def join_block(sets: list[np.ndarray], percent: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all sets of the block which links connect; ``label`` tells what is connected before.

    ``sets`` are distinct ascending hashes. Pairs inside one label are never looked at.
    """
    d = len(sets)
    sizes = np.array([len(s) for s in sets])
    vocabulary, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts > 1)  # an n-gram of one set adds to no overlap
    rank = np.full(len(vocabulary), -1, np.int64)
    rank[common[np.argsort(-counts[common], kind="stable")]] = np.arange(len(common))
    ranks, ends = rank[inverse], np.cumsum(sizes)
    local = [np.sort(r[r >= 0]) for r in np.split(ranks, ends[:-1])]
    trie = Trie(local)
    order = np.array(trie.order)
    size, label = sizes[order], label[order].copy()
    member = np.zeros((max(1, len(common)), d), np.uint8)
    for k, s in enumerate(trie.sets):
        member[s, k] = 1
    length = np.array([len(s) for s in trie.sets])
    links: list[tuple[int, int]] = []
    stack = [(0, d, 0, np.arange(d), np.zeros(d, np.int64))]
    while stack:
        low, high, depth, probes, overlap = stack.pop()
        for a, b, to in trie.children(low, high, depth):
            below = label[a:b]
            keep = probes < b - (b - a == 1)  # a pair is met once, from its earlier row
            if (below == below[0]).all():
                keep &= label[probes] != below[0]
            longest, most, least = int(length[a:b].max()), int(size[a:b].max()), int(size[a:b].min())
            keep &= (100 * most >= percent * size[probes]) & (100 * size[probes] >= percent * least)
            at, count = probes[keep], overlap[keep]
            if not len(at):
                continue
            edge = trie.sets[a][depth:to]
            if len(edge):
                count = count + member[edge].sum(axis=0, dtype=np.int64)[at]
            best = count + (longest - to)
            alive = (100 + percent) * best >= percent * (size[at] + least)  # J >= t if the longest rest were all in common, at the smallest size
            at, count = at[alive], count[alive]
            if b - a == 1 and to == len(trie.sets[a]):
                for p in at[(100 + percent) * count >= percent * (size[at] + size[a])].tolist():
                    if label[p] != label[a]:
                        links.append((int(order[p]), int(order[a])))
                        label[label == label[p]] = label[a]
            elif len(at):
                stack.append((a, b, to, at, count))
    return links


def _join_blocks(n: int, percent: int):
    """Nodes of one block, with labels, to ``label, root``: labels that links join to another, which is the anchors' if they have one there, else the least."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node", ignore_index=True)
        values, before = _sets(pa.array(pdf["text"]), n)
        sets = [values[before[k] : before[k + 1]] for k in range(len(pdf))]
        which, labels = pd.factorize(pdf["label"])
        group = np.arange(len(labels))
        for x, y in join_block(sets, percent, which):
            group[group == group[which[x]]] = group[which[y]]
        rank = labels.astype(object)  # exact integers
        best = dict.fromkeys(which[pdf["anchor"].to_numpy(bool)].tolist())
        root: dict[int, int] = {}
        for k in sorted(range(len(labels)), key=lambda k: (k not in best, rank[k])):
            root.setdefault(int(group[k]), k)
        to = np.array([root[int(g)] for g in group], np.int64)
        moved = np.flatnonzero(to != np.arange(len(labels)))
        return pd.DataFrame({"label": np.asarray(labels)[moved], "root": np.asarray(labels)[to[moved]]}, dtype="int64")

    return run


def _chunks(count: Column, grams: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / BLOCK_NODES), F.ceil(grams / BLOCK_GRAMS)).cast("int")


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for each row: the smallest id that its links reach, its own included (null without an id)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    bits = _sketch_bits(rows)
    both = materialise(rows.mapInArrow(_profile(n, bits), "id long, n long, node long, slice int, counts binary"), "grams")
    parts = both.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(_add, "slice int, counts binary").collect()
    frequency = np.zeros(((1 << bits) >> _SLICE_BITS, 1 << _SLICE_BITS), np.uint8)
    for r in parts:  # a byte for each bucket, 64 MB at most
        frequency[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    frequency = frequency.ravel()
    narrow = both.filter("slice is null").select("id", "n", "node")

    postings = rows.mapInArrow(_prefixes(n, percent, frequency), "gram long, node long, n int, place int")
    in_gram = Window.partitionBy("gram")
    shared = (
        postings.withColumn("_low", F.min("node").over(in_gram))
        .withColumn("_high", F.max("node").over(in_gram))
        .filter("_low <> _high")
        .groupBy("gram", "node")
        .agg(F.max("n").alias("n"), F.min("place").alias("place"))
        .withColumn("_g", F.count(F.lit(1)).over(in_gram))
        .withColumn("_centre", F.min("node").over(in_gram))
    )
    shared = materialise(shared, "prefixes")
    release(docs.sparkSession)
    small = shared.filter(F.col("_g") <= SMALL_GROUP).select("gram", "node", "n", "place")
    other = small.select("gram", F.col("node").alias("b"), F.col("n").alias("_n"), F.col("place").alias("_place"))
    # of two linked sets, the first n-gram in common leaves enough of both
    rest = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place"))
    fits = ((100 + percent) * rest >= percent * (F.col("n") + F.col("_n"))) & (F.col("node") < F.col("b"))
    pairs = small.join(other, "gram").filter(fits).select(F.col("node").alias("a"), "b").distinct()
    pairs = materialise(pairs, "pairs")
    stars = shared.filter((F.col("_g") > SMALL_GROUP) & (F.col("node") != F.col("_centre"))).select(F.col("node").alias("a"), F.col("_centre").alias("b"))
    candidates = connected_components(pairs.unionByName(stars)).withColumnRenamed("root", "comp")

    ids = narrow.filter("id is not null and n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    placed = candidates.join(ids, "node")
    shape = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_grams")).select("comp", _chunks(F.col("_k"), F.col("_grams")).alias("chunks"))
    placed = placed.join(shape, "comp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    texts = materialise(placed.join(rows.filter("id is not null"), "id").select("node", "comp", "chunk", "chunks", "n", "text"), "candidates")
    release(docs.sparkSession)
    run, schema = _join_blocks(n, percent), "label long, root long"
    blocks = texts.select("comp", "chunk", "node", F.col("node").alias("label"), F.lit(False).alias("anchor"), "text")
    found = materialise(blocks.groupBy("comp", "chunk").applyInPandas(run, schema), "labels")  # blocks hold different nodes: these are their groups
    label = lambda table: table.join(found.withColumnRenamed("label", "node"), "node", "left").select(table["*"], F.coalesce("root", "node").alias("label"))
    of_node = label(ids)
    large = texts.filter("chunks > 1")
    if large.limit(1).count():
        last = _finish(label(large.select("comp", "chunk", "chunks", "node", "n")), large.select("node", "text"), pairs, shared.filter(F.col("_g") > SMALL_GROUP), run, schema)
        of_node = of_node.join(last, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    of_node = materialise(of_node.select("node", "label", "id"), "groups")
    least = of_node.groupBy("label").agg(F.min("id").alias("component_id"))
    of_node = of_node.join(least, "label").select("node", "component_id")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return narrow.join(of_node, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _finish(first: DataFrame, words: DataFrame, pairs: DataFrame, shared: DataFrame, run, schema: str) -> DataFrame:
    """``label, root``: what links between the blocks of one candidate component make of the blocks' labels."""

    def main_label(table: DataFrame, by: list[str]) -> DataFrame:
        sizes = table.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_k"))
        return sizes.groupBy(*by).agg(F.max(F.struct("_k", "label")).alias("_top")).select(*by, F.col("_top.label").alias("main"))

    # against anchors: members of the first block's main group, and of every block
    first = materialise(first, "labelled")
    core = first.filter("chunk = 0").join(main_label(first.filter("chunk = 0"), ["comp"]), "comp").filter("label = main")
    anchors = core.withColumn("_r", F.row_number().over(Window.partitionBy("comp").orderBy("node"))).filter(F.col("_r") <= ANCHORS)
    spread = anchors.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1))).select("comp", "block", "node", "label", F.lit(True).alias("anchor"))
    blocks = spread.unionByName(first.filter("chunk > 0").select("comp", F.col("chunk").alias("block"), "node", "label", F.lit(False).alias("anchor")))
    more = materialise(blocks.join(words, "node").groupBy("comp", "block").applyInPandas(run, schema), "labels")  # a label lies in one block, but for the anchors', which stays
    second = first.join(more, "label", "left").withColumn("_l", F.coalesce("root", "label")).drop("root", "label").withColumnRenamed("_l", "label")
    second = materialise(second.select("comp", "chunk", "node", "n", "label"), "labelled")

    # pairs of small groups that no block has held together
    end = second.select("node", "chunk", "label")
    sides = [end.select(*[F.col(c).alias(f"{c}_{k}") for c in end.columns]) for k in "ab"]
    open_ = pairs.join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b")).filter("label_a <> label_b and chunk_a <> chunk_b")
    open_ = materialise(open_.select("a", "b", "node_a", "node_b", "label_a", "label_b"), "open-pairs")
    few = F.array(*[F.struct(F.col(f"node_{k}").alias("node"), F.col(f"label_{k}").alias("label")) for k in "ab"])
    # a node of very many partners meets them in parts
    dealt = open_.join(open_.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("_parts")), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("_parts")))
    paired = dealt.select("a", "part", F.inline(few)).distinct().join(words, "node").withColumn("anchor", F.lit(False))
    third = paired.groupBy("a", "part").applyInPandas(run, schema)

    # what is still outside the main group, against every block that it meets in a large group
    grams = shared.select("gram", "node")
    crowd = grams.select("node").distinct()
    outside = second.join(main_label(second, ["comp"]), "comp").filter("label <> main").join(crowd, "node", "left_semi")
    shape = outside.groupBy("comp").agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_grams")).select("comp", _chunks(F.col("_k"), F.col("_grams")).alias("_rests"))
    outside = outside.join(shape, "comp").withColumn("rest", F.pmod(F.xxhash64("node"), F.col("_rests")).cast("int"))
    outside = materialise(outside.select("comp", "rest", "node", "label"), "outside")
    left = outside.select("node", "comp", "rest").join(grams, "node").select("gram", "comp", "rest").distinct()
    right = second.select("node", "comp", "chunk").join(grams, "node").select("gram", "comp", "chunk").distinct()
    meet = materialise(left.join(right, ["gram", "comp"]).select("comp", "rest", "chunk").distinct(), "meets")
    probes = meet.join(outside, ["comp", "rest"])
    members = second.join(crowd, "node", "left_semi").select("comp", "chunk", "node", "label")
    targets = meet.join(members, ["comp", "chunk"])
    blocks = probes.unionByName(targets.select(*probes.columns)).select("comp", "rest", "chunk", "node", "label", F.lit(False).alias("anchor"))
    last = blocks.join(words, "node").groupBy("comp", "rest", "chunk").applyInPandas(run, schema)

    links = third.unionByName(last).select(F.col("label").alias("a"), F.col("root").alias("b"))
    roots = materialise(connected_components(links).withColumnRenamed("node", "label"), "roots")
    moved = more.join(roots.select(F.col("label").alias("root"), F.col("root").alias("_to")), "root", "left")
    of_more = moved.select("label", F.coalesce("_to", "root").alias("root"))
    return of_more.unionByName(roots.join(of_more, "label", "left_anti"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each linked group, that of its smallest id; rows without an id stay."""
    found = ngram_links(docs, n, percent, id_col, text)
    (gone,) = fresh(docs, "gone")
    hits = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(hits, F.col(id_col) == F.col(gone), "left_anti")
