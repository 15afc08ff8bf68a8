"""Query nodes. They are plain values: comparable, printable, and convertible to and from JSON."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

_KINDS: dict[str, type] = {}


class Query:
    """Base of all nodes; ``&``, ``|`` and ``~`` build boolean queries."""

    kind = ""

    def __init_subclass__(cls) -> None:
        _KINDS[cls.kind] = cls

    def __and__(self, other: Query) -> Query:
        return Bool(must=(self, other))

    def __or__(self, other: Query) -> Query:
        return Bool(should=(self, other))

    def __invert__(self) -> Query:
        return Bool(must=(MatchAll(),), must_not=(self,))

    def to_json(self) -> dict[str, Any]:
        def plain(v: Any) -> Any:
            if isinstance(v, Query):
                return v.to_json()
            return [plain(x) for x in v] if isinstance(v, (tuple, list)) else v

        return {"type": self.kind} | {f.name: plain(getattr(self, f.name)) for f in fields(self)}  # type: ignore[arg-type]

    @staticmethod
    def from_json(data: dict[str, Any]) -> Query:
        def rich(v: Any) -> Any:
            if isinstance(v, dict):
                return Query.from_json(v)
            return tuple(rich(x) for x in v) if isinstance(v, list) else v

        if data.get("type") not in _KINDS:
            raise ValueError(f"unknown query type {data.get('type')!r}")
        return _KINDS[data["type"]](**{"type" if k == "value_type" else k: rich(v) for k, v in data.items() if k != "type"})

    def children(self) -> tuple[Query, ...]:
        return ()

    def fields_used(self) -> set[str]:
        own = {self.field} if getattr(self, "field", None) else set()
        return own.union(*(c.fields_used() for c in self.children()))


@dataclass(frozen=True)
class MatchAll(Query):
    kind = "match_all"


@dataclass(frozen=True)
class MatchNone(Query):
    kind = "match_none"


@dataclass(frozen=True)
class Term(Query):
    """A whole term. ``analyzed`` lower-cases the value if the field's tokenizer does; without it the value is taken as it is."""

    field: str
    value: Any
    analyzed: bool = True
    kind = "term"

    def __post_init__(self) -> None:
        if self.value is None:
            raise ValueError("a term needs a value")


@dataclass(frozen=True)
class TermSet(Query):
    field: str
    values: tuple
    kind = "term_set"


@dataclass(frozen=True)
class FullText(Query):
    """The value is tokenised; ``mode`` is ``phrase``, ``and`` or ``or``."""

    field: str
    text: str
    mode: str = "phrase"
    slop: int = 0
    kind = "full_text"


@dataclass(frozen=True)
class Phrase(Query):
    """Terms in order; ``slop`` moves are allowed in total. Terms may be (position, term)."""

    field: str
    terms: tuple
    slop: int = 0
    prefix_last: bool = False
    kind = "phrase"

    def __post_init__(self) -> None:
        if not self.terms:
            raise ValueError("a phrase needs terms")
        if self.slop < 0:
            raise ValueError("slop must not be negative")


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str
    text: str
    distance: int = 1
    transposition_cost_one: bool = True
    prefix: bool = False
    kind = "fuzzy"

    def __post_init__(self) -> None:
        if not 0 <= self.distance <= 2:
            raise ValueError("distance must be 0, 1 or 2")


@dataclass(frozen=True)
class Regex(Query):
    field: str
    pattern: str
    kind = "regex"


@dataclass(frozen=True)
class Wildcard(Query):
    """``*`` and ``?``. ``ordered`` is one glob on one term; otherwise segments between stars may lie in any terms. ``lenient`` forgives a missing field."""

    field: str
    pattern: str
    lenient: bool = False
    ordered: bool = False
    case_sensitive: bool = False
    kind = "wildcard"


@dataclass(frozen=True)
class Range(Query):
    field: str
    lower: Any = None
    upper: Any = None
    include_lower: bool = True
    include_upper: bool = True
    type: str | None = None
    kind = "range"

    def to_json(self) -> dict[str, Any]:
        out = {"type": "range", "field": self.field, "lower": self.lower, "upper": self.upper, "include_lower": self.include_lower, "include_upper": self.include_upper}
        return out if self.type is None else out | {"value_type": self.type}


@dataclass(frozen=True)
class Exists(Query):
    field: str
    kind = "field_presence"


@dataclass(frozen=True)
class JsonTerm(Query):
    field: str
    path: str
    value: str
    kind = "json_term"


@dataclass(frozen=True)
class JsonRange(Query):
    field: str
    path: str
    lower: Any = None
    upper: Any = None
    include_lower: bool = True
    include_upper: bool = True
    kind = "json_range"


@dataclass(frozen=True)
class JsonExists(Query):
    field: str
    path: str = ""
    check_subpaths: bool = True
    kind = "json_exists"


@dataclass(frozen=True)
class IpRange(Query):
    """Addresses from ``lower`` to ``upper``, as hexadecimal 16-byte keys, made by the rewriter."""

    field: str
    lower: str | None = None
    upper: str | None = None
    include_lower: bool = True
    include_upper: bool = True
    kind = "ip_range"


@dataclass(frozen=True)
class Bool(Query):
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    minimum_should_match: int | None = None
    kind = "bool"

    def __post_init__(self) -> None:
        if not (self.must or self.should or self.must_not):
            raise ValueError("a boolean query needs a clause")

    def children(self) -> tuple[Query, ...]:
        return (*self.must, *self.should, *self.must_not)


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    boost: float
    kind = "boost"

    def __post_init__(self) -> None:
        if not self.boost > 0:
            raise ValueError("boost must be positive")

    def children(self) -> tuple[Query, ...]:
        return (self.query,)


@dataclass(frozen=True)
class ConstScore(Query):
    query: Query
    score: float
    kind = "const_score"

    def __post_init__(self) -> None:
        if not self.score >= 0:
            raise ValueError("score must not be negative")

    def children(self) -> tuple[Query, ...]:
        return (self.query,)


@dataclass(frozen=True)
class DisMax(Query):
    queries: tuple
    tie_breaker: float = 0.0
    kind = "dis_max"

    def children(self) -> tuple[Query, ...]:
        return self.queries


@dataclass
class Fields:
    """What the compiler must know about fields that the DataFrame's own types do not tell."""

    tokenizers: dict[str, str] = field(default_factory=dict)
    ips: frozenset[str] = frozenset()
    json: frozenset[str] = frozenset()
    fast: frozenset[str] | None = None
    modes: dict[str, str] = field(default_factory=dict)

    def tokenizer(self, name: str) -> str:
        return self.tokenizers.get(name, "default")


def intersection(*queries: Query) -> Bool:
    return Bool(must=queries)


def union(*queries: Query) -> Bool:
    return Bool(should=queries)


def count_fields(query: Query) -> int:
    return len(query.fields_used())


def is_expensive(pattern: str) -> bool:
    return pattern[:1] in ("*", "?") or pattern.count("*") > 1
