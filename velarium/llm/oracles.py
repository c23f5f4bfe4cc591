"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

from .cover_tree import COSINE
from .quality_rules import CHAR_LIMITS, CLASSES, COMMON, MAX_REPEAT_PERCENT, MIN_WORDS, SYMBOLS, WORD_LIMITS
from .suffix_dedup import LENGTH

WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= {COSINE}),
walk AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT l.b, w.c FROM walk w JOIN links l ON w.node = l.a),
comp AS (SELECT node, min(c) AS c FROM walk GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id"""


def _op6() -> str:
    classes = {k: p.removesuffix("+") for k, p in CLASSES.items()}
    listed = ", ".join(f"'{w}'" for w in COMMON)
    rest = "length(t) - " + " - ".join(f"len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}'))" for p in classes.values() if p != r"\p{L}")
    letters = r"len(regexp_extract_all(t, '[^\x00-\x7F]')) - len(regexp_extract_all(t, '[^\x00-\x7F\p{L}]'))"
    bins = [f"SELECT doc_id, 'c' AS kind, '{k}' AS bin, len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM d" for k, p in classes.items() if p != r"\p{L}"]
    bins += [f"SELECT doc_id, 'c', 'letter', {letters} FROM d", f"SELECT doc_id, 'c', 'other', {rest} - ({letters}) FROM d"]
    bins.append(f"SELECT doc_id, 'w', CASE WHEN list_contains([{listed}], lower(w)) THEN lower(w) ELSE '' END, count(*) FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL")
    limits = " OR ".join([f"(b.n_words >= {n} AND char_distance > {m})" for n, m in CHAR_LIMITS] + [f"(b.n_words >= {n} AND word_distance > {m})" for n, m in WORD_LIMITS])
    symbols = " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in SYMBOLS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY 1),
b AS (SELECT d.doc_id, d.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({symbols})::BIGINT AS n_symbols,
  coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
h AS ({" UNION ALL ".join(bins)}),
tot AS (SELECT doc_id, kind, sum(n) AS t FROM h GROUP BY 1, 2),
r AS (SELECT lang, kind, bin, sum(n) AS n FROM h JOIN b USING (doc_id) GROUP BY ALL),
q AS (SELECT lang, kind, bin, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM r),
j AS (SELECT b.doc_id, q.kind, coalesce(h.n, 0)::DOUBLE / tot.t AS p, coalesce(q.q, 0) AS q FROM b JOIN q ON b.lang IS NOT DISTINCT FROM q.lang
  JOIN tot ON tot.doc_id = b.doc_id AND tot.kind = q.kind LEFT JOIN h ON h.doc_id = b.doc_id AND h.kind = q.kind AND h.bin = q.bin WHERE tot.t > 0),
s AS (SELECT doc_id, kind, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END))), 6) AS x FROM j GROUP BY 1, 2),
f AS (SELECT b.*, b.n_words < {MIN_WORDS} OR 100 * b.n_repeat_words > {MAX_REPEAT_PERCENT} * b.n_words AS base_failed, coalesce(c.x, 0)::DOUBLE AS char_distance, coalesce(w.x, 0)::DOUBLE AS word_distance
  FROM b LEFT JOIN s c ON c.doc_id = b.doc_id AND c.kind = 'c' LEFT JOIN s w ON w.doc_id = b.doc_id AND w.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({limits}) AS kept, char_distance, word_distance FROM f b"""


OP6 = _op6()

#: Bytes as two hexadecimal digits; every window of LENGTH bytes as one row.
OP9 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, p, substr(x, 2 * p + 1, {2 * LENGTH}) AS w FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS p FROM d WHERE length(x) >= {2 * LENGTH})),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) < doc_id AS hit FROM g),
h AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM m WHERE hit),
s AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM h),
r AS (SELECT doc_id, span, min(p) AS a, max(p) + {LENGTH} AS b FROM s GROUP BY 1, 2),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM r),
k AS (SELECT e.doc_id, count(*) AS spans, sum(b - a)::BIGINT AS gone, max(b) AS last, string_agg(substr(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
