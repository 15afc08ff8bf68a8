"""SQL that gives the same rows, for the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t-\r]+'), lambda x: x <> '')"


def _grams(table: str, key: str) -> str:
    return (
        f"SELECT DISTINCT {key}, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 4)) AS i FROM "
        f"(SELECT {key}, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM {table}) WHERE len(w) >= 5)"
    )


DECONTAMINATION = f"""WITH d AS ({_grams("documents", "doc_id")}), b AS ({_grams("benchmark", "item_id")}),
q AS (SELECT item_id, count(*) AS q FROM b GROUP BY 1), h AS (SELECT doc_id, item_id, count(*) AS n FROM d JOIN b USING (g) GROUP BY 1, 2),
s AS (SELECT item_id, array_to_string(w, ' ') AS whole FROM (SELECT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, n AS n_shared, q AS n_item_shingles, n / q AS containment FROM h JOIN q USING (item_id) WHERE 10 * n >= 8 * q
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM documents, s WHERE contains(' ' || array_to_string({_WORDS.format("lower(coalesce(text, ''))")}, ' ') || ' ', ' ' || whole || ' ')"""

_STOP = ", ".join(f"'{form}'" for form in sorted({f for group in STOP_WORDS.values() for w in group.split() for f in (w, w.capitalize())}))

QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS rep FROM g, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, len(l) AS n, len(list_filter(w, lambda x: x IN ({_STOP}))) AS stop,
  len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•‣▪]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dots FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1 AND stop / n_words >= 0.05 AND n_dup_lines / n <= 0.5 AND bullets / n <= 0.9 AND dots / n <= 0.3 AS kept FROM f"""

WARC = """SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> m THEN m END AS refers_to FROM (SELECT page_id, url, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)"""


# Shards of nearly equal bytes in id order: where the middle of a document's bytes lies.
SHARDING = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, list_transform(range(8), lambda k: 0::bigint)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, (coalesce(strlen(text), 0) + 1)::hugeint AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::bigint) AS b FROM documents),
d AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b), lambda c, y: xor(c >> 8, list_extract(t, (xor(c, y) & 255) + 1)))) AS text_crc32 FROM b, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least(7, (2 * start + size) * 8 // (2 * total))::int AS shard FROM p)
SELECT doc_id, size::bigint AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::int AS grown_shard FROM s"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assigning every part to its nearest entry and taking floor means, one after the other."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS place, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) AS c FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS MATERIALIZED (SELECT r, j, c[j * len(c) // {parts} + 1 : (j + 1) * len(c) // {parts}] AS p FROM kept, range({parts}) t(j))",
        f"b0 AS MATERIALIZED (SELECT j, place - 1 AS e, p FROM part JOIN kept USING (r) WHERE place <= {entries})",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(part.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, j, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, j, e, {distance} AS d FROM part JOIN b{k} b USING (j)) GROUP BY r, j)")
        if k < rounds:
            mean = "SELECT j, e, list(m ORDER BY i) AS p FROM (SELECT j, e, i, floor(sum(p[i]) / count(*))::bigint AS m FROM (SELECT a.j, a.e, p, unnest(range(1, len(p) + 1)) AS i FROM a{0} a JOIN part USING (r, j)) GROUP BY j, e, i) GROUP BY j, e".format(k)
            steps.append(f"m{k} AS MATERIALIZED ({mean})")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT j, e, coalesce(m.p, b.p) AS p FROM b{k} b LEFT JOIN m{k} m USING (j, e))")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY j, e)) AS h FROM b{rounds})")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::bigint AS error FROM a{rounds} GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, h AS codebooks_sha256 FROM kept JOIN o USING (r), s"


HARD_NEGATIVES = """WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])), 0)::bigint AS score FROM k a JOIN k b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w ::int AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.b) QUALIFY row_number() OVER w <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION, "op5_quality_rules": QUALITY_RULES, "op6_warc": WARC, "op9_sharding": SHARDING, "op11_vector_codes": _vector_codes(), "op12_hard_negatives": HARD_NEGATIVES}
