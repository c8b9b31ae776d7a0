"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         greatest(0.05, 1.0 - 5.0 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)) AS w,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), keyed AS (
  SELECT *, -ln(u) / coalesce(w, 1.0) AS k FROM d
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS lim
  FROM src
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
         / sum(weight) OVER (ORDER BY lim / weight, encode(source) ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level
  FROM weighed
), goal AS (
  SELECT source, source_size, CASE WHEN lim <= weight * level THEN lim::DOUBLE
         ELSE weight * min_by(level, lim / weight) FILTER (WHERE NOT lim <= weight * level) OVER () END AS target
  FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM goal
), placed AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN size * (epochs + CASE WHEN epochs < 3 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM placed
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), s AS (
  SELECT *, len(ws) AS n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), words AS (
  SELECT r, i, ws[i] AS w FROM (SELECT r, ws, unnest(range(1, n + 1)) AS i FROM s)
), places AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS three, lead(i, 9) OVER o IS NOT NULL AS has_ten,
         string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT r, 3 AS m, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS c FROM places WHERE three IS NOT NULL) WHERE c > 1
  UNION ALL
  SELECT r, 10 AS m, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, ten) AS c FROM places WHERE has_ten) WHERE c > 1
), far AS (
  SELECT r, ws, m, unnest(range(1, n - m + 2)) AS i
  FROM (SELECT r, ws, n, 30 * n // 100 + 1 AS m FROM s WHERE n >= 50 AND r IN (SELECT r FROM again WHERE m = 10))
), cover AS (
  SELECT r, m, count(DISTINCT j) AS words FROM (SELECT r, m, unnest(range(i, i + m)) AS j FROM again) GROUP BY r, m
), long AS (
  SELECT DISTINCT r FROM (SELECT r, count(*) OVER (PARTITION BY r, hash(list_slice(ws, i, i + m - 1))) AS c FROM far) WHERE c > 1
), figures AS (
  SELECT s.doc_id, s.n::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c3.words, 0)::BIGINT AS n_repeat_words, coalesce(c10.words, 0)::BIGINT AS covered_words, long.r IS NOT NULL AS too_long
  FROM s LEFT JOIN cover c3 ON s.r = c3.r AND c3.m = 3 LEFT JOIN cover c10 ON s.r = c10.r AND c10.m = 10 LEFT JOIN long ON s.r = long.r
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * covered_words <= 30 * n_words AND NOT too_long AS kept
FROM judged
"""

OP1 = r"""
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
  SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS x FROM p
), d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (('0x' || substr(x, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) % 32 + 1, 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY x) AS first
  FROM h
)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), shingles AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id AND n.n * 5 >= m.n * 4 AND m.n * 5 >= n.n * 4
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))
), steps AS (
  SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links
), walk AS (
  SELECT DISTINCT x, x AS y FROM steps UNION SELECT walk.x, steps.y FROM walk JOIN steps ON walk.y = steps.x
), parts AS (
  SELECT x, min(y) AS component_id FROM walk GROUP BY x
)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM sizes LEFT JOIN parts ON x = doc_id
"""


def _matches(kind: int, name: str, pattern: str, test: str) -> str:
    """SQL for the valid matches of a kind: (r, k, kind, s, e, v)."""
    return f"""
  SELECT r, {kind} AS k, '{name}' AS kind, s, s + length(v) AS e, v FROM (
    SELECT r, found[i] AS v, (coalesce(list_sum(list_transform(pieces[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT r, found, string_split_regex(t, '{pattern}') AS pieces, unnest(range(1, len(found) + 1)) AS i
          FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS found FROM d) WHERE len(found) > 0))
  WHERE {test}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INTEGER ELSE {_DIGITS}[-i]::INTEGER * 2 - CASE WHEN {_DIGITS}[-i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_SPANS = " UNION ALL ".join((
    _matches(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _matches(1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE ('0' || ltrim(x, '0'))::INTEGER END)) <= 255"),
    _matches(2, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    _matches(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
))
_OTHER = r"[^\p{L}\p{N}]+"

OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text IS NULL AS no_text, coalesce(text, '') AS t FROM documents
), base AS ({_SPANS}
), sides AS (
  SELECT d.r, md5(t) AS h, k || ':' || CASE WHEN k >= 2 THEN {_DIGITS} ELSE lower(v) END AS entity, s,
         string_split_regex(lower(substr(t, greatest(s - 120, 0) + 1, least(s, 120))), '{_OTHER}') AS before,
         string_split_regex(lower(substr(t, e + 1, 120)), '{_OTHER}') AS after, length(substr(t, e + 1, 120)) AS ahead
  FROM base JOIN d ON base.r = d.r
), near AS (
  SELECT DISTINCT h, entity, list_concat(
    (list_filter(CASE WHEN s > 120 THEN before[2:] ELSE before END, lambda w: w <> ''))[-8:], (list_filter(CASE WHEN ahead = 120 THEN after[:-2] ELSE after END, lambda w: w <> ''))[:8]) AS context
  FROM sides
), contexts AS (
  SELECT DISTINCT entity, context FROM near
), entities AS (
  SELECT entity, count(*) AS n_e FROM contexts GROUP BY entity HAVING count(*) >= 3
), pairs AS (
  SELECT entity, term, count(*) AS n_te FROM (SELECT DISTINCT entity, context, unnest(context) AS term FROM contexts)
  WHERE length(term) >= 3 AND regexp_matches(term, '\p{{L}}') GROUP BY entity, term HAVING count(*) >= 3
), heard AS (
  SELECT term, count(DISTINCT h) AS n_t FROM (SELECT md5(t) AS h, unnest(list_distinct(string_split_regex(lower(t), '{_OTHER}'))) AS term FROM d WHERE NOT no_text)
  WHERE term IN (SELECT term FROM pairs) GROUP BY term
), total AS (
  SELECT count(DISTINCT t)::DOUBLE AS n FROM d WHERE NOT no_text
), terms AS (
  SELECT DISTINCT term FROM pairs JOIN entities USING (entity) JOIN heard USING (term), total
  WHERE n > n_e AND log2(least(n_te, n_t) * n / (n_t * n_e)) / -log2(n_e / n) >= 0.8
), words AS (
  SELECT r, found, string_split_regex(t, '[\p{{L}}\p{{N}}]+') AS pieces, unnest(range(1, len(found) + 1)) AS i
  FROM (SELECT r, t, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS found FROM d WHERE list_has_any(string_split_regex(lower(t), '{_OTHER}'), (SELECT coalesce(list(term), []) FROM terms)))
), places AS (
  SELECT r, found[i] AS v, (coalesce(list_sum(list_transform(pieces[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM words WHERE lower(found[i]) IN (SELECT term FROM terms)
), spans AS (
  SELECT r, k, kind, s, e FROM base
  UNION ALL SELECT r, 4, 'term', s, s + length(v) FROM places p WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = p.r AND b.s < p.s + length(p.v) AND p.s < b.e)
), joined AS (
  SELECT r, count(*) FILTER (k = 0) AS e, count(*) FILTER (k = 1) AS i, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS p,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS a
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""

SQL = {"op3_disclosure_pii": OP3, "op6_bayesian_minhash": OP6, "op1_one_bit_ann": OP1, "op7_warc_index": OP7, "op5_source_mixing": OP5, "op8_quality_rules": OP8}
