"""SQL that the results of text queries must equal, where SQL can express them."""

from __future__ import annotations

from . import quality

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _verdict() -> str:
    """Whether no rule of the table is broken, over the columns of measures."""
    cases = []
    for _, measure, least, most in quality.RULES:
        value = measure
        if measure in quality.RATIOS:
            above, below = quality.RATIOS[measure]
            value = f"(CAST({above} AS DOUBLE) / nullif({below}, 0))"
        cases += [f"coalesce({value} < CAST({least} AS DOUBLE), FALSE)"] if least is not None else []
        cases += [f"coalesce({value} > CAST({most} AS DOUBLE), FALSE)"] if most is not None else []
    return "NOT (" + " OR ".join(cases) + ")"


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))

QUALITY = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM v) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (VALUES (0), (1), (2)) o(k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_shouts,
  len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOPS}))) AS n_stop_words, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*+•·]'))) AS n_bulleted FROM d LEFT JOIN c USING (r)),
b AS (SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept, n_stop_words FROM b"""

#: After CTEs of ids (id) and of links (a, b) in both directions: rows (id, component_id).
_REACH = """reach(id, other) AS (SELECT id, id FROM ids UNION SELECT reach.id, l.b FROM reach JOIN links l ON l.a = reach.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
e AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN component ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

VECTORS = f"""WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM x WHERE len(list_filter(e, lambda v: v <> 0)) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id WHERE list_dot_product(p.e, q.e) / (p.norm * q.norm) >= CAST(0.9 AS DOUBLE)),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component ON id = vec_id LEFT JOIN n ON a = vec_id"""

SUBSTRINGS = """WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, array_slice(b, i, i + 99) AS g FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM d)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM t),
q AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS MATERIALIZED (SELECT doc_id, run, min(i) AS i, max(i) + 99 AS j FROM q GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n_spans, sum(j - i + 1) AS n_removed FROM r GROUP BY 1),
k AS (SELECT doc_id, i AS upto, coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY i), 0) + 1 AS since FROM (SELECT doc_id, i, j FROM r UNION ALL SELECT doc_id, n + 1, n + 1 FROM d)),
h AS (SELECT doc_id, string_agg(CASE WHEN upto > since THEN hex(array_slice(b, since, upto - 1)) ELSE '' END, '' ORDER BY since) AS hex FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(hex)) AS kept_sha256 FROM d JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""

SQL = {"op2_minhash_near_dedup": NEAR, "op3_suffix_dedup": SUBSTRINGS, "op4_quality_rules": QUALITY, "op6_embedding_near_dedup": VECTORS}
