"""DuckDB twins of the queries whose rows SQL can express.

The others are held against brute force in the tests: spans of weak parts and
redactions (op1), fingerprints of a hash that DuckDB lacks (op2), strings of
bytes (op3), the quantiles behind the curve (op4), tokens (op9), and learned
parts (op10).  Products (op11, op12) and words (op13) are whole numbers and exact.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, row_number() OVER () AS r FROM documents),
win AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (
  SELECT r, sum(least(5, coalesce(following - i, 5)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY 1),
measured AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(rep.n, 0) AS n_repeat_words, (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper
  FROM w LEFT JOIN rep ON rep.r = w.r),
counted AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_symbols > 25 * n_words
            OR 100 * n_dup_lines > 30 * len(lines) OR 100 * n_upper > 50 * word_chars) AS kept
FROM counted
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
later AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
lost AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM later)),
gone AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM lost GROUP BY 1),
kept AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY j) AS body
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w) u
  ANTI JOIN lost ON lost.doc_id = u.doc_id AND lost.j = u.j GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

ARCHIVES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex || '0', (5 * i) // 4 + 1, 3))::BIGINT >> (7 - (5 * i) % 4)) & 31) + 1, 1)), '') AS digest FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

MIX = rf"""
WITH RECURSIVE d AS (
  SELECT *, floor(size * 1024 / (size + 256))::BIGINT AS appeal
  FROM (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * appeal)::BIGINT AS wanted, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY 1),
l AS (
  SELECT *, 3 * source_size AS most, 3 * source_size / weight AS lim FROM s),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN wanted::DOUBLE / source_size ELSE 0.0 END AS mean, least(most::DOUBLE, weight * (SELECT arg_min(level, lim) FROM v WHERE level <= lim)) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS expected FROM t),
c AS (SELECT *, least(floor(expected), 3)::INT AS sure, target - least(floor(expected), 3) * source_size AS rest FROM e),
u AS (
  SELECT d.*, source_size, target, expected, sure, rest, expected - sure AS part,
         (expected - sure) * (1 + (1 - (expected - sure)) * (1.0::DOUBLE * (appeal - mean) / 1024)) AS chance,
         (('0x' || left(md5('8:' || coalesce(doc_id::VARCHAR, '')), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source),
r AS (
  SELECT *, part > 0 AND size > 0 AS open, (u / (1 - u)) * (1 - chance) / ((u / (1 - u)) * (1 - chance) + chance) AS rank FROM u),
z AS (
  SELECT *, sum(CASE WHEN open THEN size END) OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS total FROM r),
n AS (
  SELECT *, abs(total - rest) AS gap, total - size AS before FROM z WHERE open),
-- The place where the words of a source come nearest to what is left to take.
slots AS (
  SELECT source, least(floor(rank * 4096), 4095) AS slice, min(before) AS start, max(total) AS stop, any_value(rest) AS rest FROM n GROUP BY 1, 2),
hit AS (SELECT * FROM slots WHERE start <= rest AND rest < stop),
best AS (
  SELECT n.source, min(gap) AS gap, arg_min(total, (gap, rank)) AS upto, any_value(hit.rest - hit.start) AS none, any_value(hit.start) AS start
  FROM n JOIN hit ON hit.source IS NOT DISTINCT FROM n.source AND hit.slice = least(floor(n.rank * 4096), 4095) GROUP BY 1),
cut AS (SELECT source, CASE WHEN gap <= none THEN upto ELSE start END AS words FROM best)
SELECT z.doc_id, size, source_size, target,
       size * CASE WHEN size > 0 THEN sure + (open AND coalesce(total <= words, false))::INT ELSE 0 END AS taken
FROM z LEFT JOIN cut ON cut.source IS NOT DISTINCT FROM z.source
"""

# Vectors in whole numbers, and all products with the asking rows.
_WHOLE = """
whole AS (
  SELECT *, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
"""

PRODUCTS = f"""
WITH {_WHOLE},
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

NEGATIVES = f"""
WITH {_WHOLE},
v AS (
  SELECT vec_id, q, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label FROM whole WHERE label IS NOT NULL),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

# The checksum is taken byte by byte with the usual table of 256 remainders.
SPELLING = """
WITH RECURSIVE remainders AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e
  FROM range(256) r(i)),
t AS (SELECT list(e ORDER BY i) AS t FROM remainders),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
said AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
digits AS (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM said),
bytes AS (SELECT w, c, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM digits),
sums AS (
  SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, v: xor(s >> 8, t.t[(xor(s, v) & 255) + 1]))) AS h
  FROM bytes, t),
lost AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS w, c FROM sums),
v AS (SELECT w, sum(c)::BIGINT AS n FROM lost WHERE length(w) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
d AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM v)),
near AS (
  SELECT a.w, b.w AS o FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.w <> b.w
  UNION SELECT d.w, v.w FROM d JOIN v ON v.w = d.rest UNION SELECT v.w, d.w FROM d JOIN v ON v.w = d.rest),
best AS (
  SELECT near.w, count(*) AS n_near, arg_min(o, (-v.n, o)) AS top, max(v.n) AS top_n FROM near JOIN v ON v.w = near.o GROUP BY 1),
f AS (
  SELECT v.w, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 2 * v.n THEN top END AS form,
         CASE WHEN top_n >= 2 * v.n THEN top_n END AS form_n
  FROM v LEFT JOIN best ON best.w = v.w),
walk AS (SELECT w, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.w, f.form FROM walk JOIN f ON f.w = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.w, walk.at FROM walk JOIN f ON f.w = walk.at WHERE f.form IS NULL)
SELECT f.w AS word, form, coalesce(ends.at, f.w) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON ends.w = f.w
"""
