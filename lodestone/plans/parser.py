"""Query strings: terms, phrases, AND/OR/NOT, groups, fields, ranges, exists, wildcards and /regular expressions/.

``a b`` without an operator is ``a OR b``; ``+a`` must and ``-a`` must not match. A parse error raises ValueError; it never becomes match-all.
"""

from __future__ import annotations

import re

from ..functions import ip
from . import nodes as q

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<group>[()])|(?P<op>AND\b|OR\b|NOT\b|&&|\|\|)|(?P<sign>[+-](?=\S))
    |(?P<field>[A-Za-z_][\w.\-]*):(?=\S)
    |(?P<range>[\[{]\s*(?P<lo>"[^"]*"|[^\s\]}]+)\s+TO\s+(?P<hi>"[^"]*"|[^\s\]}]+)\s*[\]}])
    |(?P<compare>(?:>=|<=|>|<)\s*[^\s()]+)
    |"(?P<phrase>(?:[^"\\]|\\.)*)"(?:~(?P<slop>\d+))?(?P<pprefix>\*)?
    |/(?P<regex>(?:[^/\\]|\\.)+)/(?P<flags>[a-z]*)
    |(?P<word>[^\s()"]+)
    )""",
    re.X,
)


def _number(text: str):
    text = text.strip('"')
    if text == "*":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


class _Parser:
    def __init__(self, text: str, defaults: list[str], ips: frozenset[str]) -> None:
        self.text, self.at, self.defaults, self.ips = text, 0, defaults, ips
        self.ahead: re.Match | None = None

    def peek(self) -> re.Match | None:
        if self.ahead is None and self.text[self.at :].strip():
            self.ahead = _TOKEN.match(self.text, self.at)
            if not self.ahead:
                raise ValueError(f"cannot parse {self.text[self.at :]!r}")
        return self.ahead

    def take(self) -> re.Match:
        m = self.peek()
        if m is None:
            raise ValueError(f"{self.text!r} ends too early")
        self.at, self.ahead = m.end(), None
        return m

    def whole(self) -> q.Query:
        out = self.either(None)
        if (m := self.peek()) is not None:
            raise ValueError(f"unexpected {m[0].strip()!r} in {self.text!r}")
        return out

    def either(self, field: str | None) -> q.Query:
        must, should, must_not = [], [], []
        last_or = False
        while (m := self.peek()) is not None and m["group"] != ")":
            if m["op"] in ("OR", "||"):
                if not (must or should or must_not) or last_or:
                    raise ValueError(f"misplaced OR in {self.text!r}")
                self.take()
                last_or = True
                continue
            if m["op"] in ("AND", "&&"):
                raise ValueError(f"misplaced AND in {self.text!r}")
            kind, part = self.both(field)
            {"must": must, "should": should, "not": must_not}[kind].append(part)
            last_or = False
        if last_or or not (must or should or must_not):
            raise ValueError(f"an operand is missing in {self.text!r}")
        if not must and not must_not and len(should) == 1:
            return should[0]
        if must_not and not must and not should:
            must.append(q.MatchAll())
        return q.Bool(tuple(must), tuple(should), tuple(must_not))

    def both(self, field: str | None) -> tuple[str, q.Query]:
        parts = [self.unary(field)]
        while (m := self.peek()) is not None and m["op"] in ("AND", "&&"):
            self.take()
            parts.append(self.unary(field))
        if len(parts) == 1:
            return parts[0]
        must = tuple(p for k, p in parts if k != "not")
        must_not = tuple(p for k, p in parts if k == "not")
        return "should", q.Bool(must=must or (q.MatchAll(),), must_not=must_not)

    def unary(self, field: str | None) -> tuple[str, q.Query]:
        m = self.peek()
        if m is not None and m["op"] == "NOT":
            self.take()
            kind, part = self.unary(field)
            return ("should", part) if kind == "not" else ("not", part)
        if m is not None and m["sign"]:
            self.take()
            kind, part = self.unary(field)
            return ("not" if m["sign"] == "-" else "must"), part
        return "should", self.atom(field)

    def atom(self, field: str | None) -> q.Query:
        m = self.take()
        if m["group"] == "(":
            out = self.either(field)
            if (end := self.peek()) is None or end["group"] != ")":
                raise ValueError(f"a group is not closed in {self.text!r}")
            self.take()
            return self.boosted(out)
        if m["field"]:
            return self.atom(m["field"])
        if m["op"] or m["group"]:
            raise ValueError(f"unexpected {m[0].strip()!r} in {self.text!r}")
        return self.boosted(self.leaf(m, field))

    def boosted(self, out: q.Query) -> q.Query:
        if m := re.compile(r"\^(\d+(?:\.\d+)?)").match(self.text, self.at):
            self.at, self.ahead = m.end(), None
            return q.Boost(out, float(m[1]))
        return out

    def leaf(self, m: re.Match, field: str | None) -> q.Query:
        if field is None:
            if m["word"] == "*":
                return q.MatchAll()
            if not self.defaults:
                raise ValueError("no default field")
            found = [self.leaf(m, f) for f in self.defaults]
            return found[0] if len(found) == 1 else q.Bool(should=tuple(found))
        if m["range"]:
            body = m["range"]
            low, high = (x.strip('"') if field in self.ips else _number(x) for x in (m["lo"], m["hi"]))
            return q.Range(field, None if low == "*" else low, None if high == "*" else high, body[0] == "[", body[-1] == "]")
        if m["compare"]:
            op, value = re.match(r"(>=|<=|>|<)\s*(.*)", m["compare"]).groups()
            value = value if field in self.ips else _number(value)
            return q.Range(field, value, None, op == ">=") if op[0] == ">" else q.Range(field, None, value, True, op == "<=")
        if m["phrase"] is not None:
            text = re.sub(r"\\(.)", r"\1", m["phrase"])
            if m["pprefix"]:
                return q.Phrase(field, tuple(text.lower().split()), 0, True)
            return q.FullText(field, text, "phrase", int(m["slop"] or 0))
        if m["regex"]:
            return q.Regex(field, ("(?i)" if "i" in m["flags"] else "") + m["regex"])
        word = m["word"]
        boost = re.fullmatch(r"(.+)\^(\d+(?:\.\d+)?)", word)
        if boost:
            return q.Boost(self.word(boost[1], field), float(boost[2]))
        return self.word(word, field)

    def word(self, word: str, field: str) -> q.Query:
        if word == "*":
            return q.Exists(field)
        if field in self.ips:
            ip.expand(word)  # a wildcard with a gap is an error
            return q.Term(field, word)
        fuzzy = re.fullmatch(r"(.+)~([012]?)", word)
        if fuzzy:
            return q.Fuzzy(field, fuzzy[1].lower(), int(fuzzy[2] or 2))
        if re.search(r"(?<!\\)[*?]", word):
            return q.Wildcard(field, word, lenient=True, ordered=True)
        return q.FullText(field, re.sub(r"\\(.)", r"\1", word), "phrase")


def default_fields_of(schema) -> list[str]:
    """The fields that bare terms search when none are named: all text columns."""
    return [f.name for f in schema.fields if f.dataType.simpleString() in ("string", "array<string>")]


def parse_query(text: str, default_fields: list[str] | None = None, text_fields: list[str] | None = None, fields: q.Fields | None = None, schema=None) -> q.Query:
    """The query tree of a query string; without default fields, bare terms search all ``text_fields``, or all text columns of ``schema``."""
    if not text or not text.strip():
        raise ValueError("a query string must not be blank")
    if schema is not None and (unknown := [f for f in default_fields or [] if f not in schema.names]):
        raise ValueError(f"default fields that the table does not have: {unknown}")
    named = default_fields or text_fields or (default_fields_of(schema) if schema is not None else [])
    return _Parser(text, list(named), fields.ips if fields else frozenset()).whole()


def parse_lenient(text: str, default_fields: list[str] | None = None, text_fields: list[str] | None = None, fields: q.Fields | None = None) -> tuple[q.Query, list[str]]:
    """A tree in any case, and the errors: on an error, an OR of what words there are."""
    try:
        return parse_query(text, default_fields, text_fields, fields), []
    except ValueError as e:
        words = re.findall(r"\w+", text)
        names = list(default_fields or text_fields or [])
        parts = tuple(q.FullText(f, w) for w in words for f in names)
        return (q.Bool(should=parts) if parts else q.MatchNone()), [str(e)]
