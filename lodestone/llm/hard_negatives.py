"""Hard negatives: vantage-point trees over norm-augmented vectors, searched in annuli.

With one more component ``sqrt(M^2 - |x|^2)`` all vectors of a tree have the norm M, and an anchor q (extended by 0) lies at ``sqrt(|q|^2 + M^2 - 2 q.x)``
from x: a larger inner product is a smaller distance, and a window of scores is an annulus around the anchor. The rows are dealt into chunks of bounded bytes, each chunk becomes one tree
(vantage point, its distances' median between two children, leaves of LEAF rows) and one stored row. A tree answers an anchor leaf by leaf, nearest first: the triangle inequality bounds every
leaf's distances from below and above, leaves outside the annulus or beyond the k-th hit are left out, and rows of the wrong label are passed over until k are found.
First the same label's best rows (an annulus without an outer edge) give the positives, then each positive's score window its negatives. Bounds are floats widened by SLACK;
scores, windows and ties are decided by exact integers.

Anchors are sent to the trees in blocks of bounded bytes; each block is one pass over the stored trees, and Spark's top-k per group keeps k rows of each search in every task before the
shuffle. Nothing else moves: a chunk is never paired with another, no label is a group.

Defined results: rows with a null label, a null vector, or a component that is null or not finite take no part. Every row is one of its own: a repeated row is another row (of the same
label, so it may be a positive), and a repeated anchor gives its rows again. Rows without an id are no anchors; as hits they come last among equal scores. Fewer rows than asked
are all returned; anchors without a positive, and positives without a negative in their window (all of negative score), give no rows; an empty table gives an empty one. Vectors of different lengths,
and components whose products would leave exact float64 sums, are errors. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_path
from .vector_codes import finite, integers

#: Rows of a leaf, bytes of components in a chunk (as float64) and in a block of anchors.
LEAF, CHUNK, BLOCK = 256, 16 << 20, 4 << 20
#: Relative room for the rounding of distances.
SLACK = 1e-9
_EXACT = 1 << 53
_TREES = "ids array<long>, rows array<long>, labels array<long>, cells binary, width int, nodes binary, vantage array<int>, leaves array<int>, norm double"


# ---------------------------------------------------------------------- one tree
def augmented(cells: np.ndarray, norm: float | None = None) -> tuple[np.ndarray, float]:
    """The vectors with the component that makes all norms ``norm`` (by default the greatest)."""
    squares = np.einsum("ij,ij->i", cells, cells)
    most = float(squares.max(initial=0.0)) if norm is None else norm * norm
    return np.column_stack([cells, np.sqrt(np.maximum(0.0, most - squares))]), float(np.sqrt(most))


class Tree:
    """Rows in leaf order, and for each node: parent, whether it is inside its parent's median, and the least and greatest distance to the parent's vantage point."""

    def __init__(self, cells: np.ndarray, leaf: int) -> None:
        points, self.norm = augmented(cells)
        self.order, self.vantage, self.parents, self.spans, self.leaves = [], [], [], [], []
        # (rows, parent's place among inner nodes, least and greatest distance to its vantage point)
        open_ = [(np.arange(len(points)), -1, 0.0, np.inf)]
        while open_:
            rows, parent, low, high = open_.pop()
            far = None
            if len(rows) > leaf:
                start = points[rows[0]]
                pivot = rows[int(np.argmax(((points[rows] - start) ** 2).sum(1)))]  # the farthest from any one of them
                far = np.sqrt(((points[rows] - points[pivot]) ** 2).sum(1))
            if far is None or far.max() == 0:  # small, or all alike
                self.leaves.append((parent, len(self.order), len(self.order) + len(rows)))
                self.spans.append((low, high))
                self.order.extend(rows.tolist())
                continue
            at = np.argsort(far, kind="stable")
            half = len(rows) // 2
            me = len(self.vantage)
            self.vantage.append(int(pivot))
            self.parents.append((parent, low, high))
            for part in (at[half:], at[:half]):
                open_.append((rows[part], me, float(far[part].min()), float(far[part].max())))


def pack(ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, cells: np.ndarray, leaf: int) -> tuple:
    """A tree as one row of ``_TREES``."""
    tree = Tree(cells.astype(np.float64), leaf)
    order = np.array(tree.order, np.int64)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    nodes = np.array([p for p in tree.parents], np.float64).reshape(-1, 3)
    ends = np.array([(p, a, b, *s) for (p, a, b), s in zip(tree.leaves, tree.spans, strict=True)], np.float64).reshape(-1, 5)
    known = ids[order]
    return ([None if pd.isna(i) else int(i) for i in known], rows[order].tolist(), labels[order].tolist(), cells[order].astype(np.int32).tobytes(), cells.shape[1],
            np.concatenate([nodes.ravel(), ends.ravel()]).tobytes(), back[tree.vantage].tolist(), [len(nodes), len(ends)], tree.norm)


class Stored:
    """A stored tree that answers anchors."""

    def __init__(self, row: dict) -> None:
        self.width = row["width"]
        self.rows, self.labels = np.array(row["rows"], np.int64), np.array(row["labels"], np.int64)
        self.no_id = np.array([i is None for i in row["ids"]])
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        self.cells = np.frombuffer(row["cells"], np.int32).reshape(-1, self.width).astype(np.float64)
        inner, ends = row["leaves"]
        data = np.frombuffer(row["nodes"], np.float64)
        self.nodes, self.ends = data[: 3 * inner].reshape(-1, 3), data[3 * inner :].reshape(ends, 5)
        self.norm = row["norm"]
        self.points = augmented(self.cells[row["vantage"]], self.norm)[0]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each anchor to each leaf's rows."""
        squares = np.einsum("ij,ij->i", anchors, anchors)
        total = squares[:, None] + self.norm**2
        to = np.sqrt(np.maximum(0.0, total - 2 * anchors @ self.points[:, : self.width].T)) if len(self.points) else np.zeros((len(anchors), 0))
        room = SLACK * np.sqrt(total[:, 0])
        low, high = np.zeros((len(anchors), len(self.nodes))), np.full((len(anchors), len(self.nodes)), np.inf)

        def narrowed(parent: int, near: float, far: float) -> tuple[np.ndarray, np.ndarray]:
            if parent < 0:
                return np.zeros(len(anchors)), np.full(len(anchors), np.inf)
            d = to[:, parent]
            return np.maximum(low[:, parent], np.maximum(near - d, d - far) - room), np.minimum(high[:, parent], d + far + room)

        for i, (parent, near, far) in enumerate(self.nodes):  # parents come first
            low[:, i], high[:, i] = narrowed(int(parent), near, far)
        found = [narrowed(int(e[0]), e[3], e[4]) for e in self.ends]
        return np.column_stack([f[0] for f in found]), np.column_stack([f[1] for f in found])

    def search(self, anchor: np.ndarray, row: int, label: int, same: bool, windows: list[tuple[int, int, int]], k: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
        """``window, place, score`` of the best ``k`` rows of each window of scores ``(least numerator over 100, most, window's number)``, nearest leaves first."""
        total = float(anchor @ anchor) + self.norm**2
        room = SLACK * np.sqrt(total) + SLACK
        distance = lambda score: np.sqrt(max(0.0, total - 2.0 * score))
        inner = [distance(most) - room if most is not None else 0.0 for _, most, _ in windows]
        outer = [distance(least / 100) + room if least is not None else np.inf for least, _, _ in windows]
        hits: list[list[tuple[int, int, int, int]]] = [[] for _ in windows]
        for leaf in np.argsort(low, kind="stable").tolist():
            open_ = [w for w in range(len(windows)) if low[leaf] <= outer[w]]
            if not open_:
                break  # this leaf and all after it lie beyond every annulus, or beyond the k-th hits
            open_ = [w for w in open_ if high[leaf] >= inner[w]]
            if not open_:
                continue
            a, b = int(self.ends[leaf, 1]), int(self.ends[leaf, 2])
            fits = self.labels[a:b] == label
            at = a + np.flatnonzero(fits if same else ~fits)
            if same:
                at = at[self.rows[at] != row]
            if not len(at):
                continue
            scores = self.cells[at] @ anchor  # exact: integers below 2^53
            for w in open_:
                least, most, _ = windows[w]
                inside = np.ones(len(at), bool) if most is None else (100 * scores >= least) & (scores <= most)
                own = np.flatnonzero(inside)
                if len(own) > k:
                    own = own[np.lexsort((self.rows[at[own]], self.ids[at[own]], self.no_id[at[own]], -scores[own]))[:k]]
                if not len(own):
                    continue
                merged = hits[w] + [(-int(scores[o]), bool(self.no_id[at[o]]), int(self.ids[at[o]]), int(at[o])) for o in own.tolist()]
                hits[w] = sorted(merged, key=lambda h: (*h[:3], self.rows[h[3]]))[:k]
                if len(hits[w]) == k:
                    outer[w] = min(outer[w], distance(-hits[w][-1][0]) + room)
        return [(windows[w][2], h[3], -h[0]) for w in range(len(windows)) for h in hits[w]]


# ---------------------------------------------------------------------- the table
def _build(width: int, leaf: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cells = np.frombuffer(b"".join(frame["cells"]), np.int32).reshape(-1, width)
        order = np.argsort(frame["row"].to_numpy(), kind="stable")  # however the shuffle has dealt them
        ids, rows, labels = (frame[c].to_numpy()[order] for c in ("id", "row", "label"))
        return pd.DataFrame([pack(ids, rows, labels, cells[order], leaf)], columns=["ids", "rows", "labels", "cells", "width", "nodes", "vantage", "leaves", "norm"])

    return run


def _cells(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                batch = whole.slice(lo, 8192)
                cells = integers(batch.column(3), scale)
                if len(cells) and (cells.astype(np.float64) ** 2).sum(1).max() >= _EXACT / 256:
                    raise ValueError("vectors this long have no exact inner products in float64")
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in cells.astype(np.int32)], pa.binary())], names=["id", "label", "anchor", "cells"])

    return run


def _search(block: list, windows: dict[int, list[int]] | None, k: int):
    """Answers of every tree to a block of anchors: the best rows of the same label, or those of others in the score windows that ``windows`` has for a row."""
    cells = np.stack([np.frombuffer(r["cells"], np.int32) for r in block]).astype(np.float64)
    anchors = [(r["row"], r["label"]) for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                tree, out = Stored(batch.slice(number, 1).to_pylist()[0]), []
                low, high = tree.bounds(cells)
                for i, (row, label) in enumerate(anchors):
                    asked = [(None, None, 1)] if windows is None else [(80 * s, s, w) for w, s in enumerate(windows.get(row, ()), 1) if s >= 0]
                    if asked:
                        found = tree.search(cells[i], row, label, windows is None, asked, k, low[i], high[i])
                        out += [{"anchor": row, "window": w, "id": None if tree.no_id[at] else int(tree.ids[at]), "hit": int(tree.rows[at]), "score": s} for w, at, s in found]
                yield pa.RecordBatch.from_pylist(out, schema=_HITS)

    return run


_HITS = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("hit", pa.int64()), ("score", pa.int64())])


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each search over all trees, ``rank`` from 1; Spark keeps k of them in each task before it shuffles."""
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "hit")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, scale: int = 256, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its best rows of the same label, the best rows of other labels that score at least 80 % of it and no more than it."""
    spark = vectors.sparkSession
    take = F.col(label).isNotNull() & finite(F.col(vector))
    anchor = F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False))
    kept = vectors.filter(take).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), anchor.alias("anchor"), F.col(vector).alias("v"))
    rows = kept.mapInArrow(_cells(scale), "id long, label long, anchor boolean, cells binary").withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "negatives-rows")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.min(F.octet_length("cells")).alias("least"), F.max(F.octet_length("cells")).alias("most")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not shape["anchors"]:
        return spark.createDataFrame([], result)
    if shape["least"] != shape["most"]:
        raise ValueError("vectors of different lengths have no inner product")
    bytes_ = max(4, shape["most"])
    dealt = lambda n, most: F.pmod(F.xxhash64("row"), F.lit(-(-n * bytes_ // most)))
    chunks = rows.select("id", "row", "label", "cells", dealt(2 * shape["n"], CHUNK).alias("chunk"))
    trees = materialise(chunks.groupBy("chunk").applyInPandas(_build(shape["most"] // 4, LEAF), _TREES), "negatives-trees")
    anchors = materialise(rows.filter("anchor").select("row", "id", "label", "cells", dealt(shape["anchors"], BLOCK).alias("block")), "negatives-anchors", ["block"])

    at, fields = scratch_path(spark, "negatives-found"), "anchor long, window int, id long, hit long, score long"
    for number in range(-(-shape["anchors"] * bytes_ // BLOCK)):
        block = anchors.filter(F.col("block") == number).select("row", "id", "label", "cells").collect()  # about BLOCK bytes
        if not block:
            continue
        best = _top(trees.mapInArrow(_search(block, None, positives), fields), positives).collect()  # ``positives`` rows for each anchor of the block
        windows: dict[int, list[int]] = {}
        for r in sorted(best, key=lambda r: (r["anchor"], r["rank"])):
            windows.setdefault(r["anchor"], []).append(r["score"])
        ids = {r["row"]: r["id"] for r in block}
        asked = spark.createDataFrame([(r["anchor"], r["rank"], ids[r["anchor"]], r["id"], r["score"]) for r in best], "anchor long, window int, anchor_id long, positive_id long, positive_score long")
        found = _top(trees.mapInArrow(_search(block, windows, negatives), fields), negatives).join(F.broadcast(asked), ["anchor", "window"])
        found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(at)
    return spark.read.schema(result).parquet(at)
