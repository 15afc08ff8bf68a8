"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

A vector is cut into parts, and each part is coded by the index of its nearest codebook entry. For a part p, an entry e and any division of their
positions into blocks, the squared distance is at least the sum over blocks of ``length * (mean(p) - mean(e))^2 + (residual(p) - residual(e))^2``, the residual being
the norm of what is left when the mean is taken away (the means differ along the block's constant vector, what is left is orthogonal to it, and norms obey the triangle
inequality). One block gives the coarsest bound, two halves a finer one, and so on down to blocks of two. Each level drops the entries whose bound exceeds the exact
distance of the entry with the least coarse bound; floats are widened by SLACK of the norms first, so no entry that could win or tie is ever dropped. The survivors get exact integer
distances, ties to the lower index.

A round of training is one narrow pass: each task adds up its parts by entry and returns at most ``parts * entries`` rows, which Spark sums; only these sums
reach the driver (``entries`` times the vector's length numbers, whatever the rows). No vector is moved. The codes are a last pass, stored narrow; errors by label are sums before a
shuffle, joined back by broadcast if the labels are few, else by a join that no hot label bends.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; repeated rows and ids are rows of their own (the first entries are taken in the order
of id, then vector); null ids come last; with fewer kept rows than entries the codebooks are so much smaller; null labels are one label; an empty table gives an empty one. Vectors of different
lengths, a length that the parts do not divide, and components of 2^27 or more after scaling (whose squares would leave 64 bits) are errors. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lookup, materialise

#: Relative room for the rounding of float64 bounds.
SLACK = 1e-9
#: Labels up to this number are joined by broadcast.
FEW_LABELS = 100_000
_MOST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def integers(vectors: pa.Array, scale: int, most: int = _MOST) -> np.ndarray:
    """The vectors of a list column, each component as ``floor(scale * x)``, a row each; they are of one length."""
    n = len(vectors)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if n and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths have no common codebook")
    cells = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if n and np.abs(cells).max(initial=0) >= most:
        raise ValueError(f"components of {most} or more after scaling would leave the range of exact sums")
    return cells.astype(np.int64).reshape(n, int(lengths[0]) if n else 0)


def levels(width: int) -> list[np.ndarray]:
    """Where the blocks of each level begin: one block, then halves, down to blocks of two positions or fewer."""
    out, blocks = [], 1
    while True:
        out.append(np.unique(np.arange(blocks) * width // blocks))
        if width <= 2 * blocks:
            return out
        blocks *= 2


def summaries(parts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and residual norms of each row's blocks."""
    lengths = np.diff([*starts, parts.shape[1]])
    means = np.add.reduceat(parts, starts, axis=1) / lengths
    rest = parts - np.repeat(means, lengths, axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower one) and the exact squared distance, for each row of ``parts``."""
    n, width = parts.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    p, e = parts.astype(np.float64), entries.astype(np.float64)
    slack = SLACK * (np.sqrt((p * p).sum(1))[:, None] + np.sqrt((e * e).sum(1))) ** 2 + SLACK
    limit = rows = cols = None
    for starts in levels(width):
        lengths = np.diff([*starts, width])
        (pm, pr), (em, er) = summaries(p, starts), summaries(e, starts)
        if limit is None:
            bound = sum(lengths[b] * (pm[:, b, None] - em[:, b]) ** 2 + (pr[:, b, None] - er[:, b]) ** 2 for b in range(len(starts))) - slack
            first = bound.argmin(1)
            limit = ((parts - entries[first]) ** 2).sum(1)
            rows, cols = np.nonzero(bound <= limit[:, None] * (1 + SLACK))
        else:
            bound = ((pm[rows] - em[cols]) ** 2 @ lengths) + ((pr[rows] - er[cols]) ** 2).sum(1) - slack[rows, cols]
            left = bound <= limit[rows] * (1 + SLACK)
            rows, cols = rows[left], cols[left]
    exact = np.full((n, len(entries)), np.iinfo(np.int64).max)
    exact[rows, cols] = ((parts[rows] - entries[cols]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(n), best]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def _sums(books: np.ndarray, scale: int):
    """Sums of the parts by codebook and entry, a row for each that occurs in the task."""
    k, m, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, m, width), np.int64), np.zeros((k, m), np.int64)
        for batch in _batches(batches):
            cells = integers(batch.column(0), scale)
            for j in range(k):
                part = cells[:, j * width : (j + 1) * width]
                code, _ = nearest(part, books[j])
                np.add.at(total[j], code, part)
                count[j] += np.bincount(code, minlength=m)
        at = np.argwhere(count > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[count > 0]), pa.array([total[a, b].tolist() for a, b in at], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _codes(books: np.ndarray, scale: int):
    k, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            cells = integers(batch.column(2), scale)
            found = [nearest(cells[:, j * width : (j + 1) * width], books[j]) for j in range(k)]
            code = np.stack([c for c, _ in found], 1).astype(np.uint8) if k else np.zeros((len(cells), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(sum(d for _, d in found))], names=["id", "label", "code", "error"])

    return run


def train_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Codebooks ``[part, entry, position]`` of integers, from all rows: 16 first vectors, then rounds of assigning and taking floor means."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    kept = vectors.filter(finite(F.col(vector)))
    first = kept.select(F.col(vector).alias("v")).orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    cells = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale)
    if cells.shape[1] % parts:
        raise ValueError(f"{parts} equal parts do not divide {cells.shape[1]} components")
    width = cells.shape[1] // parts
    books = cells.reshape(len(cells), parts, width).transpose(1, 0, 2).copy()
    rows = kept.select(F.col(vector).alias("v"))
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(books, scale), "part int, entry int, n long, sums array<long>")
        added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        for r in added.collect():  # parts * entries rows at most
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, books: np.ndarray, scale: int = 4096, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``id_col, label, code, error`` of every kept row: one byte a part, and the squared distance summed over parts."""
    kept = vectors.filter(finite(F.col(vector)))
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label)}
    rows = kept.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    out = rows.mapInArrow(_codes(books, scale), f"id {kinds[id_col]}, label {kinds[label]}, code binary, error long")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label), "code", "error")


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of the same label, nulls together."""
    key, total = fresh(coded, "label_key", "label_sum")
    keyed = F.when(F.col(label).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(label).cast("string"))).alias(key)
    sums = materialise(coded.groupBy(keyed).agg(F.sum("error").alias(total)), "label-errors")
    rows = coded.select("*", keyed)
    if sums.count() <= FEW_LABELS:
        out = rows.join(F.broadcast(sums), key)
    else:
        out = lookup(rows, sums, key)
    return out.select(*coded.columns, F.col(total).alias("label_error"))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The coded rows with their label's error, stored, and the codebooks."""
    books = train_codebooks(vectors, parts, entries, rounds, scale, id_col, vector)
    coded = materialise(encode_vectors(vectors, books, scale, id_col, label, vector), "vector-codes")
    return label_errors(coded, label), books
