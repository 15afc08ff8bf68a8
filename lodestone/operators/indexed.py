"""Searches that read a stored index in place of the text.

An index holds, for each text field and part: ``postings`` (term, id, tf, length, positions; each file holds the rows of one task, sorted by term, so a search reads a term's row groups only), ``terms`` (each term with its document
frequency) and ``statistics`` (rows, tokens). The text is cut into tokens once, when a part is written. Which parts are live is said by a file log beside them (:mod:`..sources.txlog`), so a part that is
replaced or merged is one version for readers, and an index object keeps the parts that it began with.

A query is compiled as for a scan, but each leaf on an indexed field becomes a flag of the row's id, computed from the postings: terms and term sets by their postings; fuzzy, regular-expression
and wildcard leaves by running the same predicate over the distinct terms and reading the postings of those that match (by a pushed list if they are few, else by a semi join); phrases by interval tests
on the positions of rows that hold all their words. Leaves on other columns (ranges, addresses, JSON) are evaluated on the table, joined by id; if the query needs none, the table isn't read at all.
The score is BM25 from the stored frequencies and lengths, by the same tree walk as a scan's. Rows and scores equal those of a scan; ids must be unique.
"""

from __future__ import annotations

import dataclasses
import json
import math
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis
from ..plans import nodes as q
from ..plans.compile import Compiler, tv
from ..plans.rewrite import rewrite
from ..sources.tiers import Tiers
from ..sources.txlog import Conflict, TransactionLog, tombstones
from .search import B, K1, Scorer, postings, scoring_terms, segments

#: Terms up to this number are pushed to the scan of the postings as a list; more are joined.
LISTED = 1000


class _Leaves(Compiler):
    """Compiles leaves on indexed fields to columns that :class:`TextIndex` will compute, and remembers which."""

    def __init__(self, schema: T.StructType, fields: q.Fields, indexed: set[str]) -> None:
        super().__init__(schema, fields)
        self.indexed, self.found = indexed, {}

    def _flag(self, n: q.Query) -> Column:
        key = json.dumps(n.to_json(), default=str)
        if key not in self.found:
            self.found[key] = (f"_leaf{len(self.found)}", n)
        return tv(F.col(self.found[key][0]))

    def _tokenised(self, name: str) -> bool:
        return name not in self.indexed and super()._tokenised(name)

    def _leaf(self, n: q.Query, otherwise: Callable) -> Column:
        return self._flag(n) if n.field in self.indexed else otherwise(n)

    def term(self, n: q.Term) -> Column:
        return self._leaf(n, super().term)

    def term_set(self, n: q.TermSet) -> Column:
        return self._leaf(n, super().term_set) if n.values else F.lit(False)

    def phrase(self, n: q.Phrase) -> Column:
        return self._leaf(n, super().phrase)

    def fuzzy(self, n: q.Fuzzy) -> Column:
        return self._leaf(n, super().fuzzy)

    def regex(self, n: q.Regex) -> Column:
        return self._leaf(n, super().regex)

    def wildcard(self, n: q.Wildcard) -> Column:
        if n.field not in self.indexed:
            return super().wildcard(n)
        if not n.ordered:
            # words, and pieces in any order, may be met by different terms: a leaf each
            pieces = n.pattern.split() if len(n.pattern.split()) > 1 else [f"*{s}*" for s in n.pattern.split("*") if s] if n.pattern.count("*") > 1 else []
            if len(pieces) > 1:
                return reduce(lambda a, b: a & b, [self.wildcard(dataclasses.replace(n, pattern=p)) for p in pieces])
        return self._flag(n)


def _alone(n: q.Query, indexed: set[str]) -> bool:
    """Whether a row without a hit in the postings may match."""
    if isinstance(n, q.Bool):
        least = n.minimum_should_match if n.minimum_should_match is not None else 1 if n.should and not n.must else 0
        return bool(n.must or n.should) and all(_alone(c, indexed) for c in n.must) and sum(_alone(c, indexed) for c in n.should) >= least
    if isinstance(n, (q.Boost, q.ConstScore)):
        return _alone(n.query, indexed)
    if isinstance(n, q.DisMax):
        return any(_alone(c, indexed) for c in n.queries)
    return isinstance(n, q.Exists) or getattr(n, "field", None) not in indexed


class _Score(Scorer):
    """The scan's scorer over the stored numbers."""

    def __init__(self, compiler: _Leaves, fields: q.Fields, stats: dict) -> None:
        self.compiler, self.fields, self.stats = compiler, fields, stats
        self.terms = sorted(stats["df"])
        self.phrases: dict[str, q.Phrase] = {}

    def _part(self, idf: float, tf: Column, field: str) -> Column:
        return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.coalesce(F.col(f"_length_{field}"), F.lit(0)) / self.stats["length"][field]))

    def _idf(self, field: str, term: str) -> float:
        n, df = self.stats["n"], self.stats["df"][(field, term)]
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def bm25(self, field: str, term: str) -> Column:
        tf = F.coalesce(F.col(f"_tf{self.terms.index((field, term))}"), F.lit(0)).cast("double")
        return self._part(self._idf(field, term), tf, field)

    def phrase(self, field: str, terms: list[str]) -> Column:
        n = q.Phrase(field, tuple(terms))
        self.compiler.phrase(n)
        name = self.compiler.found[json.dumps(n.to_json(), default=str)][0]
        tf = F.coalesce(F.col(f"_often{name}"), F.lit(0)).cast("double")
        return self._part(sum(self._idf(field, t) for t in terms), tf, field)


class TextIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = TransactionLog(spark, self.path)
        self._live: list[dict] | None = None

    # ------------------------------------------------------------------ parts
    @staticmethod
    def write(df: DataFrame, path: str, id_col: str, names: list[str], fields: q.Fields | None = None, part: str = "0") -> TextIndex:
        """Index the text fields ``names`` of one part of a table; parts are added side by side, and a part of the same name is replaced."""
        out, fields = TextIndex(df.sparkSession, path), fields or q.Fields()
        for name in names:
            if name in fields.modes:
                raise ValueError(f"{name!r} has a string mode, which the index doesn't hold")
        old = [p for p in out.parts() if p["field"] in names]
        if any(part in p["names"] and len(p["names"]) > 1 for p in old):
            raise ValueError(f"part {part!r} is merged with others")
        base = out._begin()
        n = df.count()
        new = [out._add(name, postings(df, id_col, name, fields).withColumnRenamed(id_col, "id"), n, [part], fields.tokenizer(name)) for name in names]
        return out._commit([p for p in old if part in p["names"]], new, base)

    def parts(self) -> list[dict]:
        """``path, field, names, size, tokenizer`` of the live parts; size is in tokens. Compaction keeps them few."""
        if self._live is None:
            rows = self.log.list().files.select("path", "partitionValues", "size", "docMapping").collect() if self.log.current_version() >= 0 else []
            self._live = [{"path": r["path"], "field": r["partitionValues"]["field"], "names": json.loads(r["partitionValues"]["names"]), "size": r["size"], "tokenizer": r["docMapping"]} for r in rows]
        return self._live

    def _begin(self) -> int:
        """The version that a change is made from."""
        if self.log.current_version() < 0 and not self.log.write_once([{"action": "protocol", "protocolVersion": 4}, {"action": "metaData", "schemaString": "{}", "reason": "field,names"}], 0):
            self._live = None  # another writer was first
        return self.log.current_version()

    @staticmethod
    def _entry(p: dict) -> dict:
        return {"action": "add", "dataChange": True, "path": p["path"], "size": p["size"], "partitionValues": {"field": p["field"], "names": json.dumps(p["names"])}, "docMapping": p["tokenizer"]}

    def _commit(self, old: list[dict], new: list[dict], base: int) -> TextIndex:
        now = int(time.time() * 1000)
        try:
            self.log.commit([*({"action": "remove", "path": p["path"], "deletionTimestamp": now} for p in old), *map(self._entry, new)], base=base)
        except Conflict:
            for p in new:
                self._delete(p["path"])
            raise
        finally:
            self._live = None
        return self

    def _delete(self, path: str) -> None:
        for kind in ("postings", "terms", "statistics"):
            self.log._fs.delete(self.log._path(path.replace("/*/", f"/{kind}/")), True)

    def _add(self, name: str, rows: DataFrame, n: int, names: list[str], tokenizer: str) -> dict:
        """Store the postings of a new part, then its terms and statistics from them; no reader sees it before it is committed."""
        path = f"{self.path}/*/field={name}/part={uuid.uuid4().hex}"
        at = {kind: path.replace("/*/", f"/{kind}/") for kind in ("postings", "terms", "statistics")}
        segments(rows.select("term", "id", "tf", "length", "positions"), at["postings"])
        terms = self.spark.read.parquet(at["postings"]).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(at["terms"])
        total = self.spark.read.parquet(at["terms"]).agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
        total.write.parquet(at["statistics"])
        return {"path": path, "field": name, "names": names, "size": self.spark.read.parquet(at["statistics"]).first()["tokens"], "tokenizer": tokenizer}

    def _table(self, kind: str, name: str, parts: list[dict] | None = None) -> DataFrame:
        paths = [p["path"].replace("/*/", f"/{kind}/") for p in (self.parts() if parts is None else parts) if p["field"] == name]
        if not paths:
            raise ValueError(f"no index of {name!r}")
        return self.spark.read.parquet(*paths)

    def fields(self) -> set[str]:
        return {p["field"] for p in self.parts()}

    def statistics(self, name: str) -> tuple[int, int]:
        row = self._table("statistics", name).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
        return row["n"] or 0, row["tokens"] or 0

    def validate(self) -> None:
        """An error if postings, terms and statistics of a field disagree."""
        for name in sorted(self.fields()):
            held = self._table("postings", name).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"), F.count_distinct("term").alias("k"), F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("p")).first()
            terms = self._table("terms", name).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"), F.count_distinct("term").alias("k")).first()
            if not held["tf"] == held["p"] == terms["tf"] == self.statistics(name)[1] or held["k"] != terms["k"]:
                raise ValueError(f"the index of {name!r} disagrees with itself")

    def _joined(self, parts: list[dict], at: TextIndex) -> dict:
        """Parts of a field as one new part; no text is read."""
        name = parts[0]["field"]
        n = self._table("statistics", name, parts).agg(F.sum("n")).first()[0]
        return at._add(name, self._table("postings", name, parts), n, sorted({x for p in parts for x in p["names"]}), parts[0]["tokenizer"])

    def merge(self, path: str) -> TextIndex:
        """All parts as one, at a new place; no text is read."""
        out = TextIndex(self.spark, path)
        base = out._begin()
        return out._commit([], [self._joined([p for p in self.parts() if p["field"] == name], out) for name in sorted(self.fields())], base)

    def compact(self, tiers: Tiers | None = None, attempts: int = 3) -> int:
        """Merge parts of a tier of size (in tokens) as often as there are enough of them; the number of merges. If another writer takes parts away meanwhile, plan anew."""
        tiers, done, failed = tiers or Tiers(floor=1_000_000, ceiling=1_000_000_000), 0, 0
        while True:
            self._live, base = None, self._begin()
            parts = {p["path"]: p for p in self.parts()}
            rows = [(p["path"], p["field"], p["size"], k) for k, p in enumerate(parts.values())]
            due = tiers.due(self.spark.createDataFrame(rows, "path string, field string, size long, version long"), ["field"], at_once=tiers.factor).collect()
            if not due:
                return done
            group = [parts[r["path"]] for r in due]
            try:
                self._commit(group, [self._joined(group, self)], base)
                done += 1
            except Conflict:
                failed += 1
                if failed == attempts:
                    raise

    @staticmethod
    def combine(indexes: list[TextIndex], path: str) -> TextIndex:
        """One index over the parts of several, where they are: only the log is new. Ids must be unique over all of them, fields and tokenizers equal."""
        kinds = [{(p["field"], p["tokenizer"]) for p in x.parts()} for x in indexes]
        if any(k != kinds[0] for k in kinds):
            raise ValueError("the indexes differ in their fields or in a tokenizer")
        out = TextIndex(indexes[0].spark, path)
        base = out._begin()
        return out._commit([], [p | {"names": [f"{k}/{x}" for x in p["names"]]} for k, index in enumerate(indexes) for p in index.parts()], base)

    def drop_removed(self, before: int) -> int:
        """Delete the parts of this place that were removed before that time (milliseconds); how many. No reader may have begun before they were removed, and no combined index name them."""
        old = tombstones(self.log.actions()).filter(F.col("deletionTimestamp") < before).select("path").collect()
        mine = [r["path"] for r in old if r["path"].startswith(f"{self.path}/*/")]
        for path in mine:
            self._delete(path)
        return len(mine)

    # ------------------------------------------------------------------ terms
    def matching_terms(self, leaf: q.Query, fields: q.Fields) -> DataFrame:
        """The distinct terms for which a leaf holds: its predicate, run over the dictionary as over a column of one-word texts."""
        base = "whitespace" if analysis.resolve(fields.tokenizer(leaf.field))[0] in ("default", "simple", "whitespace") else "keyword"
        one = q.Fields({leaf.field: f"{base}_limit_{analysis.MAX_LIMIT}"})
        terms = self._table("terms", leaf.field).select(F.col("term").alias(leaf.field)).distinct()
        return terms.filter(Compiler(terms.schema, one).of(leaf)).select(F.col(leaf.field).alias("term"))

    def document_frequency(self, name: str, terms: list[str]) -> dict[str, int]:
        rows = self._table("terms", name).filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each asked term
        return {t: 0 for t in terms} | {r["term"]: r["df"] for r in rows}

    # ------------------------------------------------------------------ queries
    def score(self, query: q.Query, table: DataFrame, id_col: str, fields: q.Fields | None = None, scored: bool = True) -> DataFrame:
        """``id_col, _score`` of the matching rows of ``table`` (or only the ids). The table is read for what the index doesn't hold."""
        fields = fields or q.Fields()
        indexed = {f for f in self.fields() if f in table.columns and f not in fields.modes}
        compiler = _Leaves(table.schema, fields, indexed)
        tree = rewrite(query, fields)
        condition = compiler.of(tree)
        wanted = scoring_terms(query, fields) if scored else set()
        if missing := {f for f, _ in wanted} - indexed:
            raise ValueError(f"no index of {sorted(missing)}: their terms cannot be scored")
        points, scorer = F.lit(0.0), None
        if scored:
            scorer = _Score(compiler, fields, self._statistics(wanted))
            points = scorer.of(tree)
        hits = self._hits(compiler, fields, scorer)
        used = {f if f in table.columns else f.partition(".")[0] for f in query.fields_used()}
        others = sorted((used & set(table.columns)) - (indexed - {n.field for n in _existing(tree)}))
        rows = table.select(F.col(id_col).alias("_id"), *[c for c in others if c != id_col], *([id_col] if id_col in others else []))
        if _alone(tree, indexed):
            joined = rows.join(hits, rows["_id"] == hits["_hit"], "left") if hits is not None else rows
        elif hits is None:
            return table.limit(0).select(id_col, *([F.lit(0.0).alias("_score")] if scored else []))
        elif others:
            joined = rows.join(hits, rows["_id"] == hits["_hit"])
        else:
            joined = hits.withColumn("_id", F.col("_hit"))
        return joined.filter(condition).select(F.col("_id").alias(id_col), *([points.alias("_score")] if scored else []))

    def ids(self, query: q.Query, table: DataFrame, id_col: str, fields: q.Fields | None = None) -> DataFrame:
        return self.score(query, table, id_col, fields, scored=False)

    def search(self, query: q.Query, table: DataFrame, limit: int, id_col: str, fields: q.Fields | None = None, offset: int = 0) -> DataFrame:
        """The best rows by score, ties by id: ``id_col, _score``."""
        out = self.score(query, table, id_col, fields).orderBy(F.desc("_score"), F.col(id_col))
        return (out.offset(offset) if offset else out).limit(limit)

    def _statistics(self, wanted: set[tuple[str, str]]) -> dict:
        names = sorted({f for f, _ in wanted})
        rows = {f: self.statistics(f) for f in names}
        df = {}
        for f in names:
            df |= {(f, t): k for t, k in self.document_frequency(f, [t for g, t in wanted if g == f]).items()}
        return {"n": max((n for n, _ in rows.values()), default=0), "length": {f: (t / n if n else 0) or 1.0 for f, (n, t) in rows.items()}, "df": df}

    def _hits(self, compiler: _Leaves, fields: q.Fields, scorer: _Score | None) -> DataFrame | None:
        """A row for each id with a hit: the leaves' flags, the scoring terms' frequencies, the fields' lengths."""
        leaves = list(compiler.found.values())
        scoring = scorer.terms if scorer else []
        names = sorted({n.field for _, n in leaves} | {f for f, _ in scoring})
        parts, aggs, after = [], [], []
        for name in names:
            lower = analysis.lowercases(fields.tokenizer(name))
            listed, prefixes = {t for f, t in scoring if f == name}, set()
            here = F.col("_field") == name

            def of(term: Column, name: str = name) -> Column:
                return (F.col("_field") == name) & term

            for flag, leaf in [x for x in leaves if x[1].field == name]:
                if isinstance(leaf, q.Phrase) and (len(leaf.terms) > 1 or leaf.prefix_last):
                    placed = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(leaf.terms)]
                    places = []
                    for k, (_, text) in enumerate(placed):
                        as_prefix = leaf.prefix_last and k == len(placed) - 1
                        (prefixes if as_prefix else listed).add(text)
                        fits = F.col("term").startswith(text) if as_prefix else F.col("term") == text
                        places.append(f"_at{len(aggs)}")
                        aggs.append(F.flatten(F.collect_list(F.when(of(fits), F.col("positions")))).alias(places[-1]))  # of one row: as long as its text at most
                    after.append((flag, leaf, [p for p, _ in placed], places))
                    continue
                if isinstance(leaf, (q.Term, q.Phrase)):
                    value = str(leaf.value) if isinstance(leaf, q.Term) else leaf.terms[0] if isinstance(leaf.terms[0], str) else leaf.terms[0][1]
                    terms = [value.lower() if isinstance(leaf, q.Term) and leaf.analyzed and lower else value]
                elif isinstance(leaf, q.TermSet):
                    terms = sorted({str(v).lower() if lower else str(v) for v in leaf.values})
                else:
                    found = self.matching_terms(leaf, fields)
                    terms = [r["term"] for r in found.limit(LISTED + 1).collect()]  # LISTED + 1 terms at most
                if len(terms) <= LISTED:
                    listed |= set(terms)
                    aggs.append(F.bool_or(of(F.col("term").isin(terms))).alias(flag))
                else:
                    if isinstance(leaf, (q.Term, q.TermSet, q.Phrase)):
                        found = self.spark.createDataFrame([(t,) for t in terms], "term string")
                    many = self._table("postings", name).join(found, "term", "left_semi").select("id", F.lit(name).alias("_field"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf"), "length", F.lit(None).cast("array<int>").alias("positions"), F.lit(flag).alias("_leaf"))
                    parts.append(many.dropDuplicates(["id"]))
                    aggs.append(F.bool_or(F.col("_leaf") == flag).alias(flag))
            aggs.append(F.max(F.when(here, F.col("length"))).alias(f"_length_{name}"))
            asked = reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in sorted(prefixes)], F.col("term").isin(sorted(listed)))
            if listed or prefixes:
                positions = F.col("positions") if any(leaf.field == name for _, leaf, _, _ in after) else F.lit(None).cast("array<int>").alias("positions")
                parts.append(self._table("postings", name).filter(asked).select("id", F.lit(name).alias("_field"), "term", F.col("tf").cast("long").alias("tf"), "length", positions, F.lit(None).cast("string").alias("_leaf")))
        if not parts:
            return None
        aggs += [F.max(F.when((F.col("_field") == f) & (F.col("term") == t), F.col("tf"))).alias(f"_tf{k}") for k, (f, t) in enumerate(scoring)]
        rows = reduce(DataFrame.unionByName, parts).groupBy(F.col("id").alias("_hit")).agg(*aggs)
        for flag, leaf, steps, places in after:
            shifted = [_less(F.col(p), step - steps[0]) for p, step in zip(places, steps, strict=True)]
            if leaf.slop:
                held = F.when(reduce(lambda a, b: a & b, [F.size(p) > 0 for p in places]), Compiler.within_slop([F.sort_array(s) for s in shifted], leaf.slop)).otherwise(False)
                rows = rows.withColumns({flag: held, f"_often{flag}": F.lit(0)})
            else:
                starts = reduce(F.array_intersect, shifted[1:], F.array_distinct(shifted[0]))
                rows = rows.withColumn(f"_often{flag}", F.size(starts)).withColumn(flag, F.col(f"_often{flag}") > 0)
        return rows


def _less(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def _existing(n: q.Query) -> list[q.Query]:
    """The exists leaves, which are answered by the table."""
    if isinstance(n, q.Bool):
        return [x for c in (*n.must, *n.should, *n.must_not) for x in _existing(c)]
    if isinstance(n, (q.Boost, q.ConstScore)):
        return _existing(n.query)
    if isinstance(n, q.DisMax):
        return [x for c in n.queries for x in _existing(c)]
    return [n] if isinstance(n, q.Exists) else []
