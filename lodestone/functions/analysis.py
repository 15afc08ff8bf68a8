"""Tokenizers as expressions: text column to array of terms. All run inside the JVM.

Limits are in bytes; a token must be shorter than the limit. Null text stays null, which every predicate takes as "no term".
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token length limits, in bytes.
DEFAULT_LIMIT, LEGACY_LIMIT, MAX_LIMIT, MIN_LIMIT = 255, 40, 65530, 1
_CUSTOM: dict[str, Callable[[Column], Column]] = {}


def register_tokenizer(name: str, make: Callable[[Column], Column]) -> None:
    """Add a tokenizer of your own: a function from a text column to an array of terms."""
    _CUSTOM[name] = make


def resolve(name: str) -> tuple[str, int]:
    """Base tokenizer and byte limit of a name such as ``default`` or ``whitespace_limit_40``."""
    base, limit = name, DEFAULT_LIMIT
    if m := re.fullmatch(r"(.+)_limit_(\d+)", name):
        base, limit = m[1], int(m[2])
        if not MIN_LIMIT <= limit <= MAX_LIMIT:
            raise ValueError(f"token limit {limit} is not within {MIN_LIMIT}..{MAX_LIMIT}")
    if base not in ("default", "simple", "whitespace", "raw", "keyword") and base not in _CUSTOM:
        raise ValueError(f"no tokenizer is called {name!r}")
    return base, limit


def lowercases(name: str) -> bool:
    return resolve(name)[0] in ("default", "simple", "whitespace")


def tokens(text: Column, name: str = "default") -> Column:
    base, limit = resolve(name)
    if base in _CUSTOM:
        return _CUSTOM[base](text)
    if base in ("raw", "keyword"):
        return F.when(text.isNotNull(), F.array(text))
    if base == "whitespace":
        found = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    else:
        found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: F.octet_length(t) < limit)


def plain_tokens(text: str, name: str = "default") -> list[str]:
    """The same on a Python string, for query text."""
    base, limit = resolve(name)
    if base in ("raw", "keyword"):
        return [text]
    found = text.lower().split() if base == "whitespace" else re.findall(r"[^\W_]+", text.lower())
    return [t for t in found if len(t.encode()) < limit]


# Fixed value: the shape of a UUID.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def strip_matches(text: Column, pattern: str = UUID) -> Column:
    """The text without what the pattern matches, white space made single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, ""), r"\s+", " "))


def extract_matches(text: Column, pattern: str = UUID) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))


def string_mode(mode: str) -> tuple[str, str | None]:
    """``exact_only``, ``text_uuid_exactonly``, ``text_uuid_strip``, ``text_custom_exactonly:<re>`` or ``text_custom_strip:<re>``: (kind, pattern)."""
    if mode == "exact_only":
        return "exact", None
    if mode in ("text_uuid_exactonly", "text_uuid_strip"):
        return ("extract" if mode.endswith("exactonly") else "strip"), UUID
    for prefix, kind in (("text_custom_exactonly:", "extract"), ("text_custom_strip:", "strip")):
        if mode.startswith(prefix) and len(mode) > len(prefix):
            return kind, mode[len(prefix) :]
    raise ValueError(f"not a string mode: {mode!r}")


def percent_decode(value: Column) -> Column:
    """Percent-decoding that leaves a plus alone, as partition paths need."""
    return F.url_decode(F.regexp_replace(value, r"\+", "%2B"))


def truncate_utf8(text: str, limit: int) -> str:
    return text.encode()[:limit].decode(errors="ignore")


def ceiling_utf8(text: str, limit: int) -> str | None:
    """A short string not below ``text``, for an upper bound; None if there is none."""
    if len(text.encode()) <= limit:
        return text
    head = truncate_utf8(text, limit)
    for k in range(len(head) - 1, -1, -1):
        if ord(head[k]) < 0x10FFFF and not 0xD7FF <= ord(head[k]) < 0xDFFF:
            return head[:k] + chr(ord(head[k]) + 1)
    return None


def string_hash(value: Column) -> Column:
    """A 64-bit hash of a text, for grouping by a number; null stays null."""
    return F.when(value.isNotNull(), F.xxhash64(value.cast("string")))
