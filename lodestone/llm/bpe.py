"""BPE encoding and decoding: a segment tree over the ranks of a word's adjacent pairs.

A word's symbols stand in a row; the leaves of a binary tree hold the rank of each adjacent pair, inner nodes the smaller one of their
children. The root is then the lowest rank, and going down to the left wherever the left child has it leads to the leftmost pair of that
rank. Merging it changes three leaves (the pair's own, the one before, the one that is gone), each by a walk to the root, so a word of n symbols
takes O(n log n) however long it is. The merging ends when no pair is left that has a rank.

Texts are cut into words as the tokenizer file says: special tokens first, as they stand in the text, then NFC and lower case, then runs of letters,
single digits, runs of other signs and the English endings after an apostrophe. White space is dropped. Words repeat, so each task keeps the encodings of
up to KEPT short words; that changes no result. The work is a narrow pass over the rows, with no shuffle; rows are taken in slices of bounded bytes.

Defined results: a null text is an empty one; an empty or blank text has no ids, and decodes to the empty text; a text of any length and a word of any
length are encoded whole; repeated rows and ids give repeated rows; null ids pass through; an empty table gives an empty one. Only the columns asked for are read,
so other columns may have any name.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The settings of the tokenizer files that this module encodes by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Letters and numbers that Unicode 16 added, so that an interpreter with older tables cuts words alike.
NEW_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Capitals of Unicode 16 and 17 with the distance to their small letters.
NEW_CAPITALS = "1C89+1 A7CB-A567 A7CC+1 A7CE+1 A7D2+1 A7D4+1 A7DA+1 A7DC-A641 10D50..10D65+20 16EA0..16EB8+1B"
#: Combining marks that the tokenizer's tables for NFC (those of Unicode 9) don't have yet: they stay where they are, and nothing moves past them.
YOUNG_MARKS = "7FD 897-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10D69-10D6D 10EAB-10EAC 10EFC-10EFF 10F46-10F50 10F82-10F85 11070 1133B 113CE-113D0 113E1-113E2 1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 1612F 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF 1E5EE-1E5EF"
#: A final sigma is lowered like any other.
_SIGMA = {0x3A3: "σ"}
#: Words that a task keeps and how long they may be: some 60 MB. More than that and it starts anew.
KEPT, KEPT_LENGTH = 300_000, 64
#: A slice of rows is cut at these bytes of text; a longer text stands alone.
SLICE = 2 << 20
_NONE = 1 << 62
_EARLY = re.compile("[\u03a3\u07fd-\U0010ffff]")  # what texts of most scripts don't hold, at less cost than all odd characters
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _spans(listed: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (part.partition("-") for part in listed.split())]


def _ranges(kind: str, more: str, most: int) -> str:
    """The inside of a character class: the code points of a general category, up to ``most``."""
    points = {c for c in range(most + 1) if unicodedata.category(chr(c))[0] == kind}
    points |= {c for a, b in _spans(more) for c in range(a, b + 1) if c <= most}
    out, start, last = [], None, None
    for c in [*sorted(points), None]:
        if start is not None and c != last + 1 if c is not None else start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = c
        start, last = (c if start is None else start), c
    return "".join(out)


@functools.cache
def word_pattern(most: int = sys.maxunicode) -> str:
    """How to cut lowered texts of code points up to ``most`` into words."""
    letters, numbers = _ranges("L", NEW_LETTERS, most), _ranges("N", NEW_NUMBERS, most)
    space = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"


@functools.cache
def _lowering() -> dict[int, str]:
    out = dict(_SIGMA)
    for part in NEW_CAPITALS.split():
        span, sign, by = re.fullmatch(r"([0-9A-F.]+)([+-])([0-9A-F]+)", part).groups()
        first, _, last = span.partition("..")
        for c in range(int(first, 16), int(last or first, 16) + 1):
            out[c] = chr(c + int(sign + by, 16))
    return out


def _class(points: str) -> re.Pattern:
    return re.compile(f"([{points}])")


@functools.cache
def _odd() -> tuple[re.Pattern, re.Pattern]:
    """Characters that the interpreter would treat otherwise: all, and the marks among them."""
    marks = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _spans(YOUNG_MARKS))
    return _class(marks + "".join(f"\\U{c:08x}" for c in _lowering())), _class(marks)


def normalise(text: str) -> str:
    """NFC, then every character's own lower case."""
    if text.isascii():
        return text.lower()
    odd, marks = _odd()
    if _EARLY.search(text) is None or odd.search(text) is None:
        return unicodedata.normalize("NFC", text).lower()
    parts = (p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(marks.split(text)))
    return "".join(parts).translate(_lowering()).lower()


def byte_letters() -> list[str]:
    """A letter for each byte: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def merge_word(symbols: list[int], rank: dict[int, int], merged: list[int]) -> list[int]:
    """Merge the lowest-ranked, leftmost pair until none has a rank. ``rank`` is of pairs ``a << 32 | b``, ``merged`` the symbol by rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    ranked, size = rank.get, 1 << (n - 2).bit_length()
    tree = [_NONE] * size
    tree += [ranked(a << 32 | b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    tree += [_NONE] * (2 * size - len(tree))
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a <= b else b
    right, left = [*range(1, n), -1], [-1, *range(n - 1)]
    while (best := tree[1]) != _NONE:
        node = 1
        while node < size:
            node *= 2
            if tree[node] != best:
                node += 1
        at = node - size
        gone = right[at]
        beyond, before = right[gone], left[at]
        here = symbols[at] = merged[best]
        symbols[gone], right[at] = -1, beyond
        if beyond >= 0:
            left[beyond] = at
            changed = [(size + gone, _NONE), (size + at, ranked(here << 32 | symbols[beyond], _NONE))]
        else:
            changed = [(size + at, _NONE)]
        if before >= 0:
            changed.append((size + before, ranked(symbols[before] << 32 | here, _NONE)))
        for node, value in changed:
            # up to the first node that stays as it is
            while tree[node] != value:
                tree[node] = value
                if node == 1:
                    break
                beside = tree[node ^ 1]
                if beside < value:
                    value = beside
                node >>= 1
    return [s for s in symbols if s >= 0]


def merge_words(flat: np.ndarray, n: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> list[bytes]:
    """:func:`merge_word` for many short words, a step of all words at once: the trees are the rows of a table. ``flat`` is the words' symbols, ``n`` how many each has; ``keys`` are the pairs in order, with their ``ranks``."""

    def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a << 32) | b
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where((keys[at] == pair) & (a >= 0) & (b >= 0), ranks[at], _NONE)

    words, size = len(n), 1 << (int(n.max()) - 1).bit_length()  # leaves: one for each symbol, the last one's has no pair
    none = size  # the place of no symbol
    symbols = np.full((words, size + 1), -1, np.int64)
    symbols[:, :size][np.arange(size) < n[:, None]] = flat
    tree = np.full((words, 2 * size), _NONE, np.int64)
    tree[:, size:] = ranked(symbols[:, :size], symbols[:, 1:])
    for node in range(size - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    places = np.arange(size + 1, dtype=np.int32)
    right = np.where(places + 1 < n[:, None], places + 1, none).astype(np.int32)
    left = np.broadcast_to(np.where(places > 0, places - 1, none), right.shape).astype(np.int32)
    while len(rows := np.flatnonzero(tree[:, 1] != _NONE)):
        best = tree[rows, 1]
        node = np.ones(len(rows), np.int64)
        while node[0] < size:
            node *= 2
            node += tree[rows, node] != best
        at = node - size
        gone, before = right[rows, at], left[rows, at]
        beyond = right[rows, gone]
        here = merged[best]
        symbols[rows, at], symbols[rows, gone] = here, -1
        right[rows, at], left[rows, beyond] = beyond, at
        tree[rows, size + gone] = _NONE
        tree[rows, node] = ranked(here, symbols[rows, beyond])
        has = before != none
        tree[rows[has], size + before[has]] = ranked(symbols[rows[has], before[has]], here[has])
        # three leaves have changed: their ancestors, level by level
        r3 = np.concatenate([rows, rows, rows[has]])
        up = np.concatenate([node, size + gone, size + before[has]])
        while up[0] > 1:
            up = up >> 1
            tree[r3, up] = np.minimum(tree[r3, 2 * up], tree[r3, 2 * up + 1])
    there = symbols >= 0
    data, ends = symbols[there].astype(np.int32).tobytes(), np.cumsum(4 * there.sum(axis=1)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Bpe:
    """A tokenizer file of byte letters, word ends and merges."""

    def __init__(self, source: bytes) -> None:
        file = json.loads(source)
        model, cut = file["model"], json.dumps(file["pre_tokenizer"])
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or json.dumps(PATTERN)[1:-1] not in cut or "Lowercase" not in json.dumps(file["normalizer"]):
            raise ValueError("not a lower-casing BPE tokenizer with word ends")
        vocabulary, letters = model["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names = np.full(1 + max((vocabulary | self.special).values()), None, object)
        for name, i in (vocabulary | self.special).items():
            self.names[i] = name
        self.gaps = any(n is None for n in self.names)
        self.inner, self.last = [vocabulary[c] for c in letters], [vocabulary[c + WORD_END] for c in letters]
        self.rank, self.merged = {}, []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocabulary[a] << 32 | vocabulary[b], len(self.merged))
            self.merged.append(vocabulary[a + b])
        self.ascii_words, self.plane_words, self.any_words = (re.compile(word_pattern(most)) for most in (0x7F, 0xFFFF, sys.maxunicode))
        by_length = sorted(self.special, key=lambda s: (-len(s), s))
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.keys, order = np.unique(np.fromiter(self.rank, np.int64, len(self.rank)), return_index=True)
        self.ranks, self.merged_to = np.fromiter(self.rank.values(), np.int64, len(self.rank))[order], np.array(self.merged, np.int64)
        self.special_ids = {name: np.int32(i).tobytes() for name, i in self.special.items()}
        self.kept: dict[str, bytes] = {}

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, four bytes each. Words of up to KEPT_LENGTH bytes are merged together, by size of tree; longer ones alone."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            if len(raw) > KEPT_LENGTH:
                symbols = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
                out[w] = np.array(merge_word(symbols, self.rank, self.merged), np.int32).tobytes()
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((w, raw))
        inner, last = np.array(self.inner), np.array(self.last)
        for group in by_size.values():
            for lo in range(0, len(group), 20_000):
                part = group[lo : lo + 20_000]
                raw = np.frombuffer(b"".join([r for _, r in part]), np.uint8)
                n = np.array([len(r) for _, r in part])
                ends = np.cumsum(n) - 1
                flat = inner[raw]
                flat[ends] = last[raw[ends]]
                out.update(zip([w for w, _ in part], merge_words(flat, n, self.keys, self.ranks, self.merged_to), strict=True))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, four bytes each."""
        if len(self.kept) > KEPT:
            self.kept = {}
        cut = []
        for text in texts:
            parts = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else [text]
            cut.append([p if i % 2 else self._words(p) for i, p in enumerate(parts)])  # special tokens at the odd places
        kept = self.kept
        missing = {w for parts in cut for words in parts[::2] for w in words if w not in kept}
        found = self.words(list(missing))
        long = {w: ids for w, ids in found.items() if len(w) > KEPT_LENGTH}
        kept.update((w, ids) for w, ids in found.items() if w not in long)
        ids = (lambda w: kept.get(w) or long[w]) if long else kept.__getitem__
        return [b"".join(self.special_ids[p] if i % 2 else b"".join(map(ids, p)) for i, p in enumerate(parts)) for parts in cut]

    def _words(self, text: str) -> list[str]:
        text = normalise(text)
        pattern = self.ascii_words if text.isascii() else self.any_words if _BEYOND.search(text) else self.plane_words
        return pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The tokens' names with a space between, for each run of so many ids; ids that the file doesn't have are left out."""
        known = (ids >= 0) & (ids < len(self.names))
        names = self.names[np.where(known, ids, 0)]
        names[~known] = None
        names, ends = names.tolist(), np.cumsum(lengths).tolist()
        out = [names[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        strange = not known.all() or self.gaps
        return [" ".join([n for n in run if n is not None] if strange else run) for run in out]

    def decode(self, ids: list[int]) -> str:
        """The text of one text's ids."""
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


@functools.lru_cache(2)
def _loaded(source: bytes) -> Bpe:
    return Bpe(source)


def tokenizer_bytes(path: str | None = None) -> bytes:
    """The tokenizer file, read on the driver and sent along with the tasks (a vocabulary of under 64 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as file:
        source = file.read()
    if len(source) > 64 << 20:
        raise ValueError("the tokenizer file is too large to be sent to every task")
    _loaded(source)  # a file of another kind is an error now, not in a task
    return source


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about SLICE bytes of text, and one row at least."""
    for whole in batches:
        if not whole.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(1)), 0), np.int64))
        at = 0
        while at < whole.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
            yield whole.slice(at, to - at)
            at = to


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, ids``: every text's token ids. ``tokenizer`` is a file of the kind that :class:`Bpe` reads."""
    source = tokenizer_bytes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(source)
        for part in _slices(batches):
            found = bpe.encode_all([t or "" for t in part.column(1).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with the text that their ids decode to; null ids decode to the empty text."""
    source = tokenizer_bytes(tokenizer)
    at = encoded.columns.index(ids)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(encoded.schema)) + ", decoded string"
    names = [*encoded.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(source)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                lengths = pc.fill_null(pc.list_value_length(part.column(at)), 0).to_numpy(zero_copy_only=False)
                texts = pa.array(bpe.decode_all(part.column(at).flatten().to_numpy(zero_copy_only=False), lengths), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*(f"c{i}" for i in range(len(names) - 1)), "decoded"])

    return encoded.toDF(*[f"c{i}" for i in range(len(names) - 1)]).mapInArrow(run, schema).toDF(*names)
