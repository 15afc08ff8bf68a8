"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a ratio or count of a whole text, computed by built-in functions; no user function,
no shuffle, no Python on the path. A rule names a metric and the closed range that passes.

Defined results: a null or blank text has no words, so all its metrics are 0 and it fails ``n_words``;
repeated rows are judged alike, each on its own; an empty table gives an empty one. All columns of the input
stay, except that columns named like an output column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was as with be by this are at or from have not you which",
    "de": "der die das und in von zu mit den ist im des für auf nicht ein eine als auch sich an dem",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
    "fr": "de la le et les des en un une du que qui dans est pour par sur au pas plus ce il ne se",
}


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` passes; a missing bound is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        metric = F.col(self.metric)
        checks = [metric < self.low] if self.low is not None else []
        checks += [metric > self.high] if self.high is not None else []
        if not checks:
            raise ValueError(f"rule {self.name} has no bound")
        out = checks[0]
        for check in checks[1:]:
            out = out | check
        return F.coalesce(out, F.lit(True))


BASE_RULES = (Rule("too_short", "n_words", low=50), Rule("repeats_itself", "repeat_percent", high=50))
METHOD_RULES = (
    Rule("word_length", "mean_word_chars", low=2.5, high=12),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.05),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("ellipses", "ellipsis_line_ratio", high=0.3),
)


# A window's start takes the low bits of its sort key, its hash the others; texts of more windows than this take a wider key.
_START_BITS = 24


def _repeat_words(w: Column, n: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more in the text."""
    low = (1 << _START_BITS) - 1

    def covered(at: Column) -> Column:
        # at: sorted starts of repeated windows; each adds the words up to the next start, three at most
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def packed(h: Column) -> Column:
        def starts(keys: Column) -> Column:
            def same(a: Column, b: Column) -> Column:  # the whole hashes decide, where the keys' upper bits agree
                upper = F.shiftright(a.bitwiseXOR(b), _START_BITS) == 0
                full = F.get(h, a.bitwiseAND(F.lit(low)).cast("int")) == F.get(h, b.bitwiseAND(F.lit(low)).cast("int"))
                return F.coalesce(upper & full, F.lit(False))

            hit = F.filter(keys, lambda k, i: same(k, F.get(keys, i - 1)) | same(k, F.get(keys, i + 1)))
            return F.sort_array(F.transform(hit, lambda k: k.bitwiseAND(F.lit(low))))

        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        return let(let(keys, starts), covered)

    def wide(h: Column) -> Column:
        def starts(pairs: Column) -> Column:
            same = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))
            hit = F.filter(pairs, lambda p, i: same(p, F.get(pairs, i - 1)) | same(p, F.get(pairs, i + 1)))
            return F.sort_array(F.transform(hit, lambda p: p["i"].cast("long")))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(pairs, starts), covered)

    def of(h: Column) -> Column:
        unique = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(unique, F.lit(0).cast("long")).when(F.size(h) <= low, packed(h)).otherwise(wide(h))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, of))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")
RATIOS = ("repeat_percent", "mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the metrics of :data:`BASE_RULES` and :data:`METHOD_RULES` to each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({form for group in STOP_WORDS.values() for w in group.split() for form in (w, w.capitalize())})
    has_word = lambda line: line.rlike(r"[^ \t-\r]")
    kept = [F.col(c) for c in docs.columns if c not in COUNTS + RATIOS]
    whole, in_words, in_lines = fresh(docs, "whole", "words", "lines")
    out = docs.select(*kept, t.alias(whole)).withColumns({in_words: words(F.col(whole)), in_lines: F.filter(F.split(whole, "\n"), has_word)})
    w, line = F.col(in_words), F.col(in_lines)
    counts = dict(
        n_words=F.size(w),
        word_chars=F.length(F.array_join(w, "")),
        n_symbols=F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")),
        n_lines=F.size(line),
        n_dup_lines=F.size(line) - F.size(F.array_distinct(line)),
        n_repeat_words=_repeat_words(w, F.size(w)),
        n_stop_words=F.size(F.filter(w, lambda x: x.isin(stop))),
        n_bullet_lines=F.size(F.filter(line, lambda x: x.rlike(r"^\s*[-*•‣▪]"))),
        n_ellipsis_lines=F.size(F.filter(line, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    )
    # a filter on a verdict is not pushed below a generator, so no count is computed again for each rule that asks for it
    row = F.struct(*[counts[c].cast("long").alias(c) for c in COUNTS])
    out = out.select(*[F.col(c) for c in out.columns if c not in (whole, in_words, in_lines)], F.inline(F.array(row)))
    n, lines = F.col("n_words"), F.col("n_lines")
    return out.withColumns(
        {
            "repeat_percent": _share(100 * F.col("n_repeat_words"), n),
            "mean_word_chars": _share(F.col("word_chars"), n),
            "symbols_per_word": _share(F.col("n_symbols"), n),
            "stop_word_ratio": _share(F.col("n_stop_words"), n),
            "dup_line_ratio": _share(F.col("n_dup_lines"), lines),
            "bullet_line_ratio": _share(F.col("n_bullet_lines"), lines),
            "ellipsis_line_ratio": _share(F.col("n_ellipsis_lines"), lines),
        }
    )


def quality_rules(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, method: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """Judge each row: its metrics, ``failed_rules`` (names, in table order), ``base_failed`` and ``kept``."""
    names = lambda rules: [F.when(r.failed(), F.lit(r.name)) for r in rules]
    flag = lambda rules: F.greatest(F.lit(False), *(r.failed() for r in rules), F.lit(False))
    return measure(docs, text).withColumns(
        {
            "failed_rules": F.array_compact(F.array(*names(base), *names(method))),
            "base_failed": flag(base),
            "kept": ~(flag(base) | flag(method)),
        }
    )
