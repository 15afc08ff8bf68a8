"""LM scoring: a causal self-attention model over subword ids, trained and applied where the documents lie.

1. Texts are read once. Blocks of bounded size leave their distinct words and, for each document, the words' places among these; nothing
   later depends on the order of the input. The counts meet by word, each distinct word is cut into subword ids once, and count and
   ids go back to the blocks that hold the word, which are written as chunks of documents of one training slice.
2. Counts over all training documents give the model's fixed parts: which words are frequent, which of them stand near each other
   (topics), how subword ids lie among topics, and the words of each class.
3. Every training document lies in one of ROUNDS slices, by its id. A round sums the gradient over its slice, all tasks from the same
   parameters, and takes one step: dealing the documents out in another way gives the same model, up to rounding.
4. Each chunk is scored: the smoothed unigram base, and the model's own probability of every token.

Defined results: null and blank texts are their end alone; documents without an id are never held out; repeated rows count and
are scored each; without training documents all counts are 0; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import attention_lm as lm
from .common import discard, materialise, release
from .shingles import _LOWER, buffers, word_hashes, word_spans

#: Rounds of training and the rate of their steps.
ROUNDS, RATE = 12, 0.1
#: Bytes of text in a block, tokens that a task holds as vectors at once, words in which frequent words stand together.
BLOCK_BYTES, PIECE_TOKENS, NEAR = 16 << 20, 200_000, 64
_FAN_IN = 64
_TOKENIZER: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZER[path] = Tokenizer.from_file(path)
        _TOKENIZER[path].encode_special_tokens = True
    return _TOKENIZER[path]


def _encode(path: str, words: list[str]) -> list[list[int]]:
    return [e.ids for e in _tokenizer(path).encode_batch_fast([" " + w for w in words], add_special_tokens=False)]


def _pack(values: np.ndarray) -> bytes:
    """Values by the places of their bytes, which compress well, since most are small."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([_pack(values)], pa.binary())


def _blocks(texts: pa.Array) -> Iterator[slice]:
    """Runs of rows of BLOCK_BYTES at most, or of one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        done = ends[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
        yield slice(low, high)
        low = high


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values as they come, the first place and the number of each, and each value's number among them; without sorting all."""
    place, unique = pd.factorize(values)
    first = np.empty(len(unique), np.int64)
    first[place[::-1]] = np.arange(len(values))[::-1]
    return unique, first, place, np.bincount(place, minlength=len(unique))


def _used(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` numbers stand in ``places``, in order, and each place's number among these."""
    used = np.flatnonzero(np.bincount(places, minlength=n))
    number = np.zeros(n, np.uint32)
    number[used] = np.arange(len(used))
    return used, number[places]


#: A word's place, from the highest bits: its task, its block among the task's, and its number among the block's words.
_LOCAL_BITS, _BLOCK_BITS = 24, 18


def _numbered(task: int, block: int, words: int) -> int:
    """The number of a block; an error if one of its parts has no room, since blocks would be mixed up."""
    if task >> (63 - _BLOCK_BITS - _LOCAL_BITS) or block >> _BLOCK_BITS or words > 1 << _LOCAL_BITS:
        raise OverflowError(f"no number for block {block} of task {task} with {words} different words: use more, or smaller, partitions")
    return (task << _BLOCK_BITS) + block


def _read(schema: pa.Schema):
    """``id, text, slice, task`` to one row a block, ``block, ids, slices, lengths, places``, and one for each of its distinct words, ``at, word, k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for batch in batches:
            for at in _blocks(batch.column(1)):
                part = batch.slice(at.start, at.stop - at.start)
                slices = np.asarray(part.column(2)).astype(np.int8)
                data, offsets = buffers(part.column(1))
                lower = _LOWER[data]
                spans = []
                for lo in range(0, part.num_rows, 256):  # a hash of words takes eight bytes for each of the texts' bytes
                    low, high = offsets[lo], offsets[min(lo + 256, part.num_rows)]
                    starts, ends, before = word_spans(lower[low:high], offsets[lo : lo + 257] - low)
                    spans.append((word_hashes(lower[low:high], starts, ends), starts + low, ends + low, np.diff(before)))
                hashes, starts, ends, lengths = (np.concatenate([x[k] for x in spans]) for k in range(4))
                spans.clear()
                unique, first, place, often = _distinct(hashes.view(np.int64))
                order = np.lexsort((unique, -often))  # frequent words get small numbers
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                first, place = first[order], rank[place]
                k = np.bincount(place, np.repeat(slices >= 0, lengths), len(first)).astype(np.int64)
                number = _numbered(int(part.column(3)[0].as_py()), block, len(first))
                block += 1
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                row = {"block": pa.array([number]), "ids": ids, "slices": _packed(slices), "lengths": _packed(lengths.astype(np.int64)), "places": _packed(place.astype(np.uint32))}
                yield _row(row, 1, schema)
                raw = lower.tobytes()
                for lo in range(0, len(first), 50_000):
                    own = slice(lo, lo + 50_000)
                    words = pa.array([raw[a:b] for a, b in zip(starts[first[own]].tolist(), ends[first[own]].tolist(), strict=True)], pa.binary())
                    n = len(words)
                    yield _row({"at": pa.array((number << _LOCAL_BITS) + np.arange(lo, lo + n)), "word": words, "k": pa.array(k[own])}, n, schema)

    return run


def _row(columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_JOINED = "block long, data binary, n long, v long, c long, hash long, ids binary"


def _join_words(path: str, kind: type):
    """Sorted by hash: ``hash, at, word, k`` to what blocks, and to what the corpus needs to know.

    For some words of a block one row ``block, data``; for some words, each once, ``n, v, data`` (training tokens, training words); and
    ``c, hash, ids`` of those that may be among the most frequent.
    """
    schema = to_arrow_schema(_parse_datatype_string(_JOINED))

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes, counts, at = (rows[name].to_numpy() for name in ("hash", "k", "at"))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        c = np.bincount(inverse, counts, len(unique)).astype(np.int64)
        found = _encode(path, [w.as_py().decode("utf-8", "replace") for w in rows["word"].take(pa.array(first))])
        sizes = np.array([len(x) for x in found], np.int64)
        flat, starts = np.array([i for x in found for i in x], kind), np.cumsum(sizes) - sizes
        known = np.flatnonzero(c > 0)
        if len(known):
            yield _row({"n": pa.array([int(c.sum())]), "v": pa.array([len(known)]), "data": pa.array([pickle.dumps(_words_of(known, c, sizes, starts, flat))], pa.binary())}, 1, schema)
            top = known[np.argsort(-c[known], kind="stable")[: lm.FREQUENT]]
            own = pa.array([np.array(found[i], kind).tobytes() for i in top.tolist()], pa.binary())
            yield _row({"c": pa.array(c[top]), "hash": pa.array(unique[top]), "ids": own}, len(top), schema)
        order = np.argsort(at, kind="stable")
        blocks = at[order] >> _LOCAL_BITS
        cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        data = []
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            own = order[low:high]
            data.append(pickle.dumps((_pack((at[own] & ((1 << _LOCAL_BITS) - 1)).astype(np.uint32)), *_words_of(inverse[own], c, sizes, starts, flat))))
        yield _row({"block": pa.array(blocks[cuts]), "data": pa.array(data, pa.binary())}, len(cuts), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                table = pa.Table.from_batches(held).combine_chunks()
                hashes = table["hash"].to_numpy()
                cut = int(np.searchsorted(hashes, hashes[-1]))
                if cut:
                    yield from emit(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = len(table) - cut
        if rows:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return run


def _words_of(which: np.ndarray, c: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counts, numbers of subword ids, and subword ids of some words."""
    n = sizes[which]
    ids = flat[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return _pack(c[which]), _pack(n.astype(np.uint32)), _pack(ids)


_CHUNK = ("lengths", "places", "c", "sizes", "word_ids", "frequent")


def _rank(frequent: list[bytes], least: int, c: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Each word's place among the frequent words, or -1; they are told by their subword ids, and are counted ``least`` times at least."""
    place = {ids: k for k, ids in enumerate(frequent)}
    starts, out = np.cumsum(sizes) - sizes, np.full(len(c), -1, np.int64)
    for k in np.flatnonzero(c >= least).tolist() if frequent else ():
        out[k] = place.get(flat[starts[k] : starts[k] + sizes[k]].tobytes(), -1)
    return out


def _chunks(frequent: list[bytes], least: int, kind: type, schema: pa.Schema):
    """A block and its words to a row for each training slice of its documents."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        parts = [pickle.loads(x.as_py()) for x in words["data"]]
        local, c, sizes, flat = (np.concatenate([_unpack(p[k], t) for p in parts] or [np.zeros(0, t)]) for k, t in enumerate((np.uint32, np.int64, np.uint32, kind)))
        parts.clear()
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        rank = _rank(frequent, least, c, sizes, flat).astype(np.int16)
        by = np.argsort(local)
        c, sizes, starts, rank = c[by], sizes[by], starts[by], rank[by]
        out = []
        for row in docs.to_batches():
            for k in range(row.num_rows):
                slices, lengths, places = (_unpack(row[n][k].as_py(), t) for n, t in (("slices", np.int8), ("lengths", np.int64), ("places", np.uint32)))
                of_slice = np.repeat(slices, lengths)
                for s in np.unique(slices):
                    mine = np.flatnonzero(slices == s)
                    used, place = _used(places[of_slice == s], len(c))
                    n = sizes[used]
                    own = flat[np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    data = dict(zip(_CHUNK, (lengths[mine], place.astype(np.uint32), c[used], n.astype(np.uint32), own, rank[used]), strict=True))
                    ids_of = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), row["ids"][k].values.take(pa.array(mine)))
                    out.append(_row({"slice": pa.array([int(s)], pa.int32()), "ids": ids_of} | {n: _packed(v) for n, v in data.items()}, 1, schema))
        return pa.Table.from_batches(out, schema)

    return run


class Chunk:
    """Documents of one slice: the words' counts and subword ids, and each document's words by place."""

    def __init__(self, batch: pa.RecordBatch, k: int, kind: type) -> None:
        get = lambda name, t: _unpack(batch[name][k].as_py(), t)
        self.lengths, self.places, self.c, self.sizes = get("lengths", np.int64), get("places", np.uint32), get("c", np.int64), get("sizes", np.uint32).astype(np.int64)
        self.ids, self.frequent = get("word_ids", kind), get("frequent", np.int16).astype(np.int64)

    def pieces(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Documents, their lengths with ends, and the words of their tokens; an end is one past the last word."""
        with_end = self.lengths + 1
        ends, low = np.cumsum(with_end), 0
        while low < len(with_end):
            done = ends[low] - with_end[low]
            high = max(low + 1, int(np.searchsorted(ends, done + PIECE_TOKENS, "right")))
            own = with_end[low:high]
            stream = np.full(own.sum(), len(self.c), np.int64)
            inner = np.ones(len(stream), bool)
            inner[np.cumsum(own) - 1] = False
            stream[inner] = self.places[done - low : done - low + inner.sum()]
            yield slice(low, high), own, stream
            low = high


def _each(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[pa.RecordBatch, int, Chunk]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch, k, Chunk(batch, k, kind)


def _summed(parts: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], table: DataFrame) -> dict[str, np.ndarray] | None:
    """Sum of what ``parts`` makes of each task's rows, by a tree of groups of _FAN_IN; the driver takes its last level, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(parts(batches)), 1)], pa.binary())], names=["part"])

    def add(pdf):
        whole: dict[str, np.ndarray] | None = None
        for packed in pdf["part"]:
            one = pickle.loads(zlib.decompress(packed))
            whole = one if whole is None else {k: whole[k] + v for k, v in one.items()}
        return pdf.iloc[:1].assign(part=[zlib.compress(pickle.dumps(whole), 1)])[["k", "part"]]

    level = table.mapInArrow(run, "part binary").withColumn("k", F.shiftright(F.spark_partition_id(), 6)).select("k", "part")
    level = level.groupBy("k").applyInPandas(add, "k int, part binary")
    level = level.withColumn("k", F.shiftright("k", 6)).groupBy("k").applyInPandas(add, "k int, part binary")
    whole: dict[str, np.ndarray] | None = None
    for row in level.select("part").coalesce(1).toLocalIterator():  # one job, not one for each partition
        one = pickle.loads(zlib.decompress(row["part"]))
        whole = one if whole is None else {k: whole[k] + v for k, v in one.items()}
    return whole


def _near(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some documents: the words of their tokens without ends, the window of NEAR words each lies in, and counts of frequent words by window."""
    for _, lengths, stream in chunk.pieces():
        stream = stream[stream < len(chunk.c)]
        n = lengths - 1
        place = np.arange(len(stream)) - np.repeat(np.cumsum(n) - n, n)
        window = np.cumsum(place % NEAR == 0) - 1
        rank = chunk.frequent[stream]
        has = rank >= 0
        width = int(window[-1]) + 1 if len(window) else 0
        yield stream, window, np.bincount(window[has] * lm.FREQUENT + rank[has], minlength=width * lm.FREQUENT).reshape(width, lm.FREQUENT)


def _together(kind: type):
    """How often each two frequent words stand in one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((lm.FREQUENT, lm.FREQUENT))
        for _, _, chunk in _each(batches, kind):
            for _, _, counts in _near(chunk):
                total += counts.T.astype(float) @ counts
        return {"total": total}

    return run


def _by_topic(group: np.ndarray, ids: int, kind: type):
    """How often each subword id lies in a window of each topic, that of most of its frequent words."""
    member = np.zeros((lm.FREQUENT, lm.TOPICS))
    member[np.arange(len(group)), group] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros(ids * lm.TOPICS, np.int64)
        for _, _, chunk in _each(batches, kind):
            by_word = np.zeros(len(chunk.c) * lm.TOPICS, np.int64)
            for stream, window, counts in _near(chunk):
                topic = counts @ member
                tells = topic.max(axis=1, initial=0)[window] > 0
                by_word += np.bincount(stream[tells] * lm.TOPICS + topic.argmax(axis=1)[window[tells]], minlength=len(by_word)) if len(stream) else 0
            by_word = by_word.reshape(-1, lm.TOPICS)
            at = chunk.ids.astype(np.int64) * lm.TOPICS
            words = np.repeat(np.arange(len(chunk.c)), chunk.sizes)
            for z in range(lm.TOPICS):
                total += np.bincount(at + z, by_word[words, z], len(total)).astype(np.int64)
        return {"total": total}

    return run


def _class_sizes(seen: lm.Words, frequent: list[bytes], least: int, kind: type):
    """Training tokens and distinct training words of each class, from rows that hold each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        tokens, types = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
        for batch in batches:
            for data in batch.column(0):
                c, sizes, flat = (_unpack(x, t) for x, t in zip(pickle.loads(data.as_py()), (np.int64, np.uint32, kind), strict=True))
                sizes = sizes.astype(np.int64)
                classes, _ = seen.look(flat, sizes, _rank(frequent, least, c, sizes, flat), c)
                tokens += np.bincount(classes, c, lm.CLASSES)
                types += np.bincount(classes, minlength=lm.CLASSES)
        return {"tokens": tokens, "types": types}

    return run


def _gradient(p: lm.Parameters, seen: lm.Words, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = {k: np.zeros(v.shape) for k, v in p.items()} | {"n": np.zeros(1), "loss": np.zeros(1)}
        for _, _, chunk in _each(batches, kind):
            classes, vectors = seen.look(chunk.ids, chunk.sizes, chunk.frequent, chunk.c)
            classes, vectors = np.append(classes, lm.END), np.vstack([vectors, lm.END_VECTOR])
            for _, lengths, stream in chunk.pieces():
                g, loss = lm.gradient(p, vectors[stream], classes[stream], lengths)
                for k, v in g.items():
                    total[k] += v
                total["n"] += len(stream)
                total["loss"] += loss
        return total

    return run


def train(chunks: DataFrame, seen: lm.Words, class_tokens: np.ndarray, kind: type) -> lm.Parameters:
    """One step for each slice of the training documents."""
    p, step = lm.initial(class_tokens), lm.Adam(RATE)
    for r in range(ROUNDS):
        g = _summed(_gradient(p, seen, kind), chunks.filter(F.col("slice") == r))
        n = g.pop("n")[0] if g else 0
        if n:
            p = step(p, {k: g[k] / n for k in p})
    return p


def _score(p: lm.Parameters, seen: lm.Words, sizes: dict[str, np.ndarray], n: int, v: int, ends: int, kind: type, schema: pa.Schema):
    floor = n + v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, chunk in _each(batches, kind):
            classes, vectors = seen.look(chunk.ids, chunk.sizes, chunk.frequent, chunk.c)
            of_class = (chunk.c + 1) / (sizes["tokens"][classes] + sizes["types"][classes] + 1)
            within = np.append(np.where(classes < lm.OWN, 0.0, np.log10(of_class)), 0.0)
            base = np.append(np.log10((chunk.c + 1) / floor), np.log10((ends + 1) / floor))
            known = np.append(chunk.c > 0, ends > 0)
            classes, vectors = np.append(classes, lm.END), np.vstack([vectors, lm.END_VECTOR])
            held = pa.array([batch["slice"][k].as_py() < 0])
            for docs, lengths, stream in chunk.pieces():
                logs = lm.score(p, vectors[stream], classes[stream], lengths) / np.log(10) + within[stream]
                first = np.cumsum(lengths) - lengths
                total = lambda x, at=first: pa.array(np.add.reduceat(x, at))
                m = len(lengths)
                columns = {
                    "id": batch["ids"][k].values.slice(docs.start, m), "held_out": held.take(pa.array(np.zeros(m, np.int64))), "n_tokens": pa.array(lengths), "n_known": total(known[stream].astype(np.int64)),
                    "train_tokens": pa.array(np.full(m, n)), "base_score": total(base[stream]), "score": total(logs),
                }
                yield _row(columns, m, schema)

    return run


def score_documents(docs: DataFrame, tokenizer: str | None = None, ids: int = 50_257, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10) for each row.

    ``tokenizer`` is a tokenizer file that every executor can read; ``ids`` the size of its vocabulary.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark, kind, id_kind = docs.sparkSession, np.uint16 if ids <= 1 << 16 else np.uint32, docs.schema[id_col].dataType.simpleString()
    arrow = lambda schema: to_arrow_schema(_parse_datatype_string(schema))
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    piece = F.when(crc % 7 == 2, -1).otherwise(F.coalesce((F.floor(crc / 7) % ROUNDS).cast("int"), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), piece.alias("slice"), F.spark_partition_id().alias("task"))
    schema = f"block long, ids array<{id_kind}>, slices binary, lengths binary, places binary, at long, word binary, k long"
    both = materialise(rows.mapInArrow(_read(arrow(schema)), schema), "lm-blocks")

    # a word has at most one row for each block
    counted = both.filter("word is not null").select(F.xxhash64("word").alias("hash"), "at", "word", "k").repartition("hash").sortWithinPartitions("hash")
    words = materialise(counted.mapInArrow(_join_words(tokenizer, kind), _JOINED), "lm-words")
    release(spark)
    one = words.filter("n is not null")
    n, v = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    top = words.filter("c is not null").orderBy(F.desc("c"), "hash").select("c", "ids").limit(lm.FREQUENT).collect()
    frequent, least = [bytes(r["ids"]) for r in top], min((r["c"] for r in top), default=0)
    ends = rows.filter("slice >= 0").count()
    n, v = n + ends, v + (ends > 0)

    chunk_schema = f"slice int, ids array<{id_kind}>, " + ", ".join(f"{name} binary" for name in _CHUNK)
    blocks = both.filter("word is null").select("block", "ids", "slices", "lengths", "places").groupBy("block")
    by_block = words.filter("block is not null").select("block", "data").groupBy("block")
    chunks = materialise(blocks.cogroup(by_block).applyInArrow(_chunks(frequent, least, kind, arrow(chunk_schema)), chunk_schema), "lm-chunks")
    discard(both)
    release(spark)

    training = chunks.filter("slice >= 0")
    empty = {"total": np.zeros((lm.FREQUENT, lm.FREQUENT))}
    group = lm.topics((_summed(_together(kind), training) or empty)["total"][: len(frequent), : len(frequent)]) if len(frequent) else np.zeros(0, np.int64)
    found = _summed(_by_topic(group, ids, kind), training)
    seen = lm.Words(lm.profiles(found["total"].reshape(ids, lm.TOPICS) if found else np.zeros((ids, lm.TOPICS))))
    sizes = _summed(_class_sizes(seen, frequent, least, kind), one.select("data"))
    sizes = sizes or {"tokens": np.zeros(lm.CLASSES), "types": np.zeros(lm.CLASSES)}
    sizes["tokens"][lm.END] = ends
    discard(words)
    p = train(chunks, seen, sizes["tokens"], kind)

    out = f"id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.mapInArrow(_score(p, seen, sizes, n, v, ends, kind, arrow(out)), out).withColumnRenamed("id", id_col)
