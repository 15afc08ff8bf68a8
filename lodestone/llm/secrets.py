"""Secret scans: one deterministic automaton for all rules, one byte pass.

All rules are compiled by subset construction and minimisation into one transition array, which runs over
the bytes of a batch of texts once and names the stretches that hold any match. Only in those are the spans read off,
leftmost and not overlapping within a kind, by the automata of the single rules.

Defined results: null and empty texts have no spans; repeated rows are scanned each; offsets count code points, the end is
exclusive; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, compile_all, parse, scan
from .shingles import buffers


@dataclass(frozen=True)
class SecretRule:
    """A match is ``head`` and then ``body``; matches whose body (with ``whole``, the whole) is shorter than ``least`` are dropped."""

    kind: str
    head: str
    body: str
    least: int
    whole: bool = False
    ignore_case: bool = False


# The kinds that the contract lists, in its order.
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, ignore_case=True),
    SecretRule("access", "AKIA", "[A-Z0-9]", 20, whole=True),
    SecretRule("hex", "", "[0-9a-f]", 24),
)
# Published formats of credentials.
MORE_RULES = (
    SecretRule("github", "gh[opsru]_", "[A-Za-z0-9]", 36),
    SecretRule("google", "AIza", "[A-Za-z0-9_-]", 35),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", r"[A-Za-z0-9_.-]", 16),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-", "-", 4),
    SecretRule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]", 10),
    SecretRule("stripe", "[rs]k_live_", "[A-Za-z0-9]", 16),
)


@cache
def compiled(rules: tuple[SecretRule, ...]) -> tuple[Automaton, list[tuple[Automaton, Automaton, np.ndarray]], int]:
    """The combined automaton, for each rule those of its match and its head and its possible first bytes, and the shortest match.

    The combined automaton asks for a body of ``least`` only where that keeps it small; a longer body is asked for when spans are read.
    """
    combined, single, shortest = [], [], []
    for r in rules:
        head = parse(r.head, r.ignore_case)
        least = max(1, r.least - len(r.head) if r.whole else r.least)
        asked = least if r in BASE_RULES else min(least, 4)
        combined.append(("cat", (head, parse(r.body + "{%d}" % asked, r.ignore_case))))
        match = compile_all([("cat", (head, parse(r.body + "+", r.ignore_case)))])
        lead = match.table[match.class_of[np.arange(256)]] != match.dead
        single.append((match, compile_all([head]), lead))
        shortest.append(asked + len(r.head.split("(")[0].split("[")[0]))
    return compile_all(combined, anywhere=True, stop_at_match=True), single, min(shortest)


def _spans(data: bytes, rules: tuple[SecretRule, ...], single: list) -> Iterator[tuple[int, int, int]]:
    """``start, rule, end`` in bytes."""
    raw = np.frombuffer(data, np.uint8)
    for k, (rule, (match, head, lead)) in enumerate(zip(rules, single, strict=True)):
        done = 0
        for start in np.flatnonzero(lead[raw]).tolist():
            if start < done:
                continue
            end = match.longest(data, start)
            if end < 0:
                continue
            done = end
            from_ = start if rule.whole else head.longest(data, start)
            if end - from_ >= rule.least:
                yield start, k, end


def _scan(rules: tuple[SecretRule, ...], base: int):
    def text_of(found: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(found))

    combined, single, shortest = compiled(rules)  # once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                data, offsets = buffers(batch.column(1))
                spans: dict[int, list[tuple[int, int, int]]] = {}
                starts, ends = scan(combined, data, offsets, shortest)
                rows = np.searchsorted(offsets, starts, side="right") - 1
                chars: dict[int, np.ndarray] = {}
                for row, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    if row not in chars:
                        own = data[offsets[row] : offsets[row + 1]]
                        chars[row] = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    c, at = chars[row], a - offsets[row]
                    spans.setdefault(row, []).extend((int(c[at + s]), k, int(c[at + e])) for s, k, e in _spans(data[a:b].tobytes(), rules, single))
                counts = np.zeros((batch.num_rows, base), np.int64)
                digests, texts = [hashlib.sha256(b"").hexdigest()] * batch.num_rows, [""] * batch.num_rows
                for row, found in spans.items():
                    for _, k, _ in found:
                        if k < base:
                            counts[row, k] += 1
                    digests[row] = hashlib.sha256(text_of([x for x in found if x[1] < base]).encode()).hexdigest()
                    texts[row] = text_of(found)
                names = ["id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=names)

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", more: tuple[SecretRule, ...] = MORE_RULES) -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` for each row; ``spans`` is ``kind:start:end`` of every match, comma-joined."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + "".join(f"n_{r.kind} long, " for r in BASE_RULES) + "base_sha256 string, spans string"
    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(_scan(BASE_RULES + more, len(BASE_RULES)), schema).withColumnRenamed("id", id_col)
