"""Passes over the query tree before it is compiled: addresses to ranges, string modes, and the costs by which clauses are ordered."""

from __future__ import annotations

import dataclasses
import re

from ..functions import analysis, ip
from . import nodes as q


def cost(query: q.Query) -> int:
    """0 for what needs no tokens, 1 for terms, 2 for scans of all terms, 3 for patterns that no prefix narrows."""
    if isinstance(query, (q.Range, q.Exists, q.MatchAll, q.MatchNone, q.IpRange)):
        return 0
    if isinstance(query, (q.Regex, q.Fuzzy)) or (isinstance(query, q.Wildcard) and q.is_expensive(query.pattern)):
        return 3
    if isinstance(query, (q.Wildcard, q.Phrase)):
        return 2
    return max((cost(c) for c in query.children()), default=1)


def _map(query: q.Query, f) -> q.Query:
    if isinstance(query, q.Bool):
        query = dataclasses.replace(query, **{k: tuple(_map(c, f) for c in getattr(query, k)) for k in ("must", "should", "must_not")})
    elif isinstance(query, (q.Boost, q.ConstScore)):
        query = dataclasses.replace(query, query=_map(query.query, f))
    elif isinstance(query, q.DisMax):
        query = dataclasses.replace(query, queries=tuple(_map(c, f) for c in query.queries))
    return f(query)


def rewrite(query: q.Query, fields: q.Fields) -> q.Query:
    def address(n: q.Query) -> q.Query:
        if getattr(n, "field", None) not in fields.ips:
            return n
        if isinstance(n, (q.Term, q.FullText, q.Wildcard)):
            text = n.value if isinstance(n, q.Term) else n.text if isinstance(n, q.FullText) else n.pattern
            found = ip.expand(str(text))
            if found is None:
                raise ValueError(f"not an address: {text!r}")
            return q.MatchAll() if ip.matches_all(*found) else q.IpRange(n.field, found[0].hex(), found[1].hex())
        if isinstance(n, q.TermSet):
            return q.Bool(should=tuple(address(q.Term(n.field, v)) for v in n.values)) if n.values else q.MatchNone()
        if isinstance(n, q.Range):
            low, high = (None if b in (None, "*") else ip.key_of(str(b)).hex() for b in (n.lower, n.upper))
            return q.IpRange(n.field, low, high, n.include_lower, n.include_upper)
        return n

    def mode(n: q.Query) -> q.Query:
        name = getattr(n, "field", None)
        if name not in fields.modes or isinstance(n, (q.Exists, q.Range)):
            return n
        kind, pattern = analysis.string_mode(fields.modes[name])
        if kind == "exact":
            if isinstance(n, (q.Wildcard, q.Regex, q.Fuzzy)) or (isinstance(n, q.Phrase) and n.prefix_last):
                raise ValueError(f"{name!r} holds exact values only; {n.kind} cannot be answered")
            text = n.value if isinstance(n, q.Term) else n.text if isinstance(n, q.FullText) else " ".join(n.terms) if isinstance(n, q.Phrase) else None
            return q.Term(name, text, analyzed=False) if text is not None else n
        if kind == "extract" and isinstance(n, (q.Term, q.FullText)):
            text = str(n.value if isinstance(n, q.Term) else n.text)
            if m := re.search(pattern, text):
                return q.Term(f"{name}__uuids", m[0], analyzed=False)
        return n

    return _map(_map(query, address), mode)


def with_string_modes(df, fields: q.Fields):
    """The columns that the string modes ask for: stripped texts, and ``<field>__uuids`` with what was taken out."""
    from pyspark.sql import functions as F

    for name, text in fields.modes.items():
        kind, pattern = analysis.string_mode(text)
        if kind == "exact":
            fields.tokenizers[name] = "raw"
            continue
        if kind == "extract":
            companion = f"{name}__uuids"
            if companion in df.columns:
                raise ValueError(f"column {companion!r} exists already")
            df = df.withColumn(companion, analysis.extract_matches(F.col(name), pattern))
            fields.tokenizers[companion] = "raw"
        df = df.withColumn(name, analysis.strip_matches(F.col(name), pattern))
    return df
