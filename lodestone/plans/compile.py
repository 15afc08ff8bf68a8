"""Query tree to boolean Column.

Every leaf is two-valued: a null field holds no term, so a negated clause keeps its row. Literals are cast to the column's
type, never the column, so comparisons reach the Parquet scan. Cheap clauses of a conjunction come first.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis
from ..functions.ip import ip_key
from . import nodes as q
from .rewrite import cost, rewrite


def tv(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


class Compiler:
    def __init__(self, schema: T.StructType, fields: q.Fields | None = None) -> None:
        self.schema, self.fields = schema, fields or q.Fields()
        self._given: dict[str, Column] = {}  # tokens that an enclosing clause has bound

    # ------------------------------------------------------------------ fields
    def type_of(self, name: str) -> T.DataType:
        for f in self.schema.fields:
            if f.name == name:
                return f.dataType
        raise ValueError(f"no field {name!r}")

    def column(self, name: str) -> Column:
        self.type_of(name)
        return F.col(f"`{name}`")

    def is_text(self, name: str) -> bool:
        return isinstance(self.type_of(name), T.StringType) and name not in self.fields.ips

    def terms(self, name: str) -> Column:
        kind = self.type_of(name)
        if name in self._given:
            return self._given[name]
        if isinstance(kind, T.ArrayType):
            return F.flatten(F.transform(self.column(name), lambda t: analysis.tokens(t, self.fields.tokenizer(name))))
        if not self.is_text(name):
            raise ValueError(f"{name!r} is not a text field")
        return analysis.tokens(self.column(name), self.fields.tokenizer(name))

    def raw(self, name: str) -> bool:
        return analysis.resolve(self.fields.tokenizer(name))[0] in ("raw", "keyword")

    def literal(self, name: str, value) -> Column:
        kind = self.type_of(name)
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) and isinstance(value, int):
            return F.timestamp_micros(F.lit(value)).cast(kind)
        if isinstance(kind, T.DecimalType) and isinstance(value, (int, float)) and value < 0 and kind.scale == 0:
            raise ValueError(f"negative bound on unsigned field {name!r}")
        return F.lit(value).cast(kind)

    # ------------------------------------------------------------------ nodes
    def compile(self, query: q.Query) -> Column:
        return self.of(rewrite(query, self.fields))

    def of(self, query: q.Query) -> Column:
        return getattr(self, query.kind)(query)

    def match_all(self, _) -> Column:
        return F.lit(True)

    def match_none(self, _) -> Column:
        return F.lit(False)

    def term(self, n: q.Term) -> Column:
        if "." in n.field and n.field not in self.schema.names:
            head, _, path = n.field.partition(".")
            return self.json_term(q.JsonTerm(head, path, str(n.value)))
        if not self.is_text(n.field) and not isinstance(self.type_of(n.field), T.ArrayType):
            return tv(self.column(n.field) == self.literal(n.field, n.value))
        value = str(n.value)
        value = value.lower() if n.analyzed and analysis.lowercases(self.fields.tokenizer(n.field)) else value
        if self.raw(n.field) and self.is_text(n.field):
            return tv(self.column(n.field) == F.lit(value))
        return tv(F.array_contains(self.terms(n.field), F.lit(value)))

    def term_set(self, n: q.TermSet) -> Column:
        if not n.values:
            return F.lit(False)
        if not self.is_text(n.field):
            return tv(self.column(n.field).isin([self.literal(n.field, v) for v in n.values]))
        lower = analysis.lowercases(self.fields.tokenizer(n.field))
        values = [str(v).lower() if lower else str(v) for v in n.values]
        if self.raw(n.field):
            return tv(self.column(n.field).isin(values))
        return tv(F.arrays_overlap(self.terms(n.field), F.array(*map(F.lit, values))))

    def full_text(self, n: q.FullText) -> Column:
        if not self.is_text(n.field):
            return self.term(q.Term(n.field, n.text))
        found = analysis.plain_tokens(n.text, self.fields.tokenizer(n.field))
        if not found:
            return F.lit(False)
        if n.mode == "phrase":
            return self.phrase(q.Phrase(n.field, tuple(found), n.slop))
        parts = [self.term(q.Term(n.field, t)) for t in found]
        return reduce(lambda a, b: a & b if n.mode == "and" else a | b, parts)

    def phrase(self, n: q.Phrase) -> Column:
        terms = self.terms(n.field)
        placed = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(n.terms)]
        if len(placed) == 1 and not n.prefix_last:
            return tv(F.array_contains(terms, F.lit(placed[0][1])))
        base = placed[0][0]
        steps = [(p - base, t) for p, t in placed]

        def fits(x: Column, k: int) -> Column:
            text = steps[k][1]
            return x.startswith(text) if n.prefix_last and k == len(steps) - 1 else x == text

        def exact(ts: Column) -> Column:
            return F.exists(
                F.sequence(F.lit(0), F.size(ts) - 1),
                lambda i: reduce(lambda a, b: a & b, [F.coalesce(fits(F.get(ts, i + d), k), F.lit(False)) for k, (d, _) in enumerate(steps)]),
            )

        def sloppy(ts: Column) -> Column:
            # offsets of each term, less its place in the phrase
            def places(k: int) -> Column:
                at = F.transform(ts, lambda t, i: F.when(F.coalesce(fits(t, k), F.lit(False)), i - F.lit(steps[k][0])))
                return F.filter(at, lambda x: x.isNotNull())

            return self.within_slop([places(k) for k in range(len(steps))], n.slop)

        bound = F.transform(F.array(terms), lambda ts: F.when(F.size(ts) == 0, F.lit(False)).otherwise(sloppy(ts) if n.slop else exact(ts)))
        return tv(bound.getItem(0))

    @staticmethod
    def within_slop(places: list[Column], slop: int) -> Column:
        """Whether one offset of each array can be chosen so that their spread is within the slop."""

        def widened(found: Column, r: Column) -> Column:
            both = F.transform(found, lambda x: F.struct(F.least(r["lo"], x).alias("lo"), F.greatest(r["hi"], x).alias("hi")))
            return F.filter(both, lambda s: s["hi"] - s["lo"] <= slop)

        ranges = F.transform(places[0], lambda x: F.struct(x.alias("lo"), x.alias("hi")))
        for found in places[1:]:
            ranges = F.flatten(F.transform(ranges, lambda r: widened(found, r)))  # noqa: B023  (called at once)
        return F.size(ranges) > 0

    def fuzzy(self, n: q.Fuzzy) -> Column:
        d = n.distance

        def osa(t: Column) -> Column:
            # one transposition of neighbours may stand for two edits; for d <= 2 it is enough to try each swap of the query
            swaps = {n.text[:i] + n.text[i + 1] + n.text[i] + n.text[i + 2 :] for i in range(len(n.text) - 1) if n.text[i] != n.text[i + 1]}
            plain = F.levenshtein(t, F.lit(n.text)) <= d
            if not n.transposition_cost_one or d == 0:
                return plain
            swapped = [F.levenshtein(t, F.lit(s)) <= d - 1 for s in sorted(swaps)]
            return reduce(lambda a, b: a | b, swapped, plain)

        def near(t: Column) -> Column:
            if not n.prefix:
                return osa(t)
            heads = [osa(F.substring(t, 1, k)) for k in range(max(0, len(n.text) - d), len(n.text) + d + 1)]
            return reduce(lambda a, b: a | b, heads)

        return tv(F.exists(self.terms(n.field), near))

    def regex(self, n: q.Regex) -> Column:
        re.compile(n.pattern)
        return tv(F.exists(self.terms(n.field), lambda t: t.rlike(f"^(?:{n.pattern})$")))

    def wildcard(self, n: q.Wildcard) -> Column:
        missing = n.field not in self.schema.names
        if n.lenient and (missing or not self.is_text(n.field)):
            return F.lit(False)
        pattern = n.pattern if n.case_sensitive or not analysis.lowercases(self.fields.tokenizer(n.field)) else n.pattern.lower()
        terms = self.terms(n.field)
        if n.ordered:
            return tv(F.exists(terms, lambda t: t.rlike(glob(pattern))))
        parts = pattern.split()
        if len(parts) > 1:
            return reduce(lambda a, b: a & b, [self.wildcard(q.Wildcard(n.field, p, n.lenient)) for p in parts])
        if pattern.count("*") > 1:
            segments = [s for s in pattern.split("*") if s]
            if not segments:
                return tv(F.size(terms) > 0)
            hold = lambda s: F.exists(terms, lambda t: t.rlike(glob(s)[1:-1]) if "?" in s else t.contains(s))
            return tv(reduce(lambda a, b: a & b, [hold(s) for s in segments]))
        if not re.search(r"[*?]", pattern):
            return tv(F.array_contains(terms, F.lit(pattern)))
        if pattern.endswith("*") and "?" not in pattern:
            return tv(F.exists(terms, lambda t: t.startswith(pattern[:-1])))
        return tv(F.exists(terms, lambda t: t.rlike(glob(pattern))))

    def range(self, n: q.Range) -> Column:
        if "." in n.field and n.field not in self.schema.names:
            head, _, path = n.field.partition(".")
            return self.json_range(q.JsonRange(head, path, n.lower, n.upper, n.include_lower, n.include_upper))
        kinds = {"INTEGER": T.IntegralType, "UNSIGNED": (T.DecimalType, T.IntegralType), "FLOAT": T.FractionalType, "DATE": (T.TimestampType, T.TimestampNTZType, T.DateType)}
        if n.type in kinds and not isinstance(self.type_of(n.field), kinds[n.type]):
            raise ValueError(f"{n.field!r} is not of type {n.type}")
        c, out = self.column(n.field), []
        if n.lower is not None:
            low = self.literal(n.field, n.lower)
            out.append(c >= low if n.include_lower else c > low)
        if n.upper is not None:
            high = self.literal(n.field, n.upper)
            out.append(c <= high if n.include_upper else c < high)
        return tv(reduce(lambda a, b: a & b, out)) if out else c.isNotNull()

    def field_presence(self, n: q.Exists) -> Column:
        if "." in n.field and n.field not in self.schema.names:
            head, _, path = n.field.partition(".")
            return self.json_exists(q.JsonExists(head, path))
        if self.fields.fast is not None and n.field not in self.fields.fast:
            raise ValueError(f"exists needs a fast field; {n.field!r} is not")
        return self.column(n.field).isNotNull()

    # ------------------------------------------------------------------ JSON and IP
    def variant(self, field: str) -> Column:
        kind = self.type_of(field)
        c = self.column(field)
        if isinstance(kind, T.StringType):
            return F.try_parse_json(c)
        return F.to_variant_object(c) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else c

    @staticmethod
    def path(path: str) -> str:
        return "$" + "".join(f".{p}" if re.fullmatch(r"\w+", p) else f"['{p}']" for p in path.split(".") if p)

    def json_term(self, n: q.JsonTerm) -> Column:
        if not isinstance(n.value, str):
            raise ValueError("a JSON term needs a string")
        text = F.try_variant_get(self.variant(n.field), self.path(n.path), "string")
        return tv(F.array_contains(analysis.tokens(text), F.lit(n.value.lower())))

    def json_range(self, n: q.JsonRange) -> Column:
        whole = all(b is None or isinstance(b, int) for b in (n.lower, n.upper))
        c = F.try_variant_get(self.variant(n.field), self.path(n.path), "bigint" if whole else "double")
        out = [c.isNotNull()]
        if n.lower is not None:
            out.append(c >= F.lit(n.lower) if n.include_lower else c > F.lit(n.lower))
        if n.upper is not None:
            out.append(c <= F.lit(n.upper) if n.include_upper else c < F.lit(n.upper))
        return tv(reduce(lambda a, b: a & b, out))

    def json_exists(self, n: q.JsonExists) -> Column:
        found = F.try_variant_get(self.variant(n.field), self.path(n.path), "variant")
        there = found.isNotNull() & ~F.is_variant_null(found)
        return tv(there if n.check_subpaths else there & ~F.schema_of_variant(found).startswith("OBJECT"))

    def ip_range(self, n: q.IpRange) -> Column:
        c, out = ip_key(self.column(n.field)), []
        if n.lower is not None:
            low = F.lit(bytes.fromhex(n.lower))
            out.append(c >= low if n.include_lower else c > low)
        if n.upper is not None:
            high = F.lit(bytes.fromhex(n.upper))
            out.append(c <= high if n.include_upper else c < high)
        return tv(reduce(lambda a, b: a & b, out)) if out else tv(c.isNotNull())

    # ------------------------------------------------------------------ composites
    def bool(self, n: q.Bool) -> Column:
        # (cost, fields, how to compile) of what must hold
        all_of = [(cost(c), c.fields_used(), lambda c=c: self.of(c)) for c in n.must] + [(cost(c), c.fields_used(), lambda c=c: ~self.of(c)) for c in n.must_not]
        least = n.minimum_should_match
        if least is None:
            least = 1 if n.should and not n.must else 0
        if least > len(n.should):
            return F.lit(False)
        if not n.must and not n.should:
            return F.lit(False)  # negation alone matches nothing; it must be paired with match_all
        if n.should and least:

            def enough() -> Column:
                hits = [self.of(c) for c in n.should]
                return reduce(lambda a, b: a | b, hits) if least == 1 else reduce(lambda a, b: a + b, [h.cast("int") for h in hits]) >= least

            all_of.append((max(cost(c) for c in n.should), set().union(*(c.fields_used() for c in n.should)), enough))
        if not all_of:
            return F.lit(True)
        all_of.sort(key=lambda x: x[0])
        uses = Counter(f for c in (*n.must, *n.must_not, *(n.should if least else ())) for f in c.fields_used() if self._tokenised(f))
        name = next((f for f, k in uses.most_common(1) if k > 1), None)
        free = [make() for _, used, make in all_of if name not in used]
        if name is None:
            return reduce(lambda a, b: a & b, free)

        def bound(ts: Column) -> Column:
            self._given[name] = ts
            try:
                return reduce(lambda a, b: a & b, [make() for _, used, make in all_of if name in used])
            finally:
                del self._given[name]

        # a field that several clauses search is cut into tokens once, and only for rows that the others leave
        return reduce(lambda a, b: a & b, [*free, F.transform(F.array(self.terms(name)), bound).getItem(0)])

    def _tokenised(self, name: str) -> bool:
        return name in self.schema.names and name not in self._given and self.is_text(name) and not self.raw(name)

    def boost(self, n: q.Boost) -> Column:
        return self.of(n.query)

    def const_score(self, n: q.ConstScore) -> Column:
        return self.of(n.query)

    def dis_max(self, n: q.DisMax) -> Column:
        return reduce(lambda a, b: a | b, [self.of(c) for c in n.queries]) if n.queries else F.lit(False)


def glob(pattern: str) -> str:
    """Anchored regular expression of a wildcard; a backslash makes the next character literal."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def matching(df: DataFrame, query: q.Query, fields: q.Fields | None = None) -> DataFrame:
    """The rows that match, unscored."""
    return df.filter(Compiler(df.schema, fields).compile(query))
