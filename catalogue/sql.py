"""Building blocks of the SQL twins (DuckDB dialect), written apart from the Spark code."""

from __future__ import annotations

from gleaner.functions.text import STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def camel(word: str) -> str:
    """RE2 has no lookahead: blanks at the seams give the same parts."""
    out = word
    for pattern in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        out = f"regexp_replace({out}, '{pattern}', '\\1 \\2', 'g')"
    return f"string_split({out}, ' ')"


def tokens(name: str, source: str, key: str, text: str) -> str:
    """CTE name(key, tok): one row per token, duplicates kept."""
    return f"""
{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z0-9]+')) AS w FROM {source}),
{name}_p AS (SELECT {key}, {camel('w')} AS parts FROM {name}_w),
{name} AS (
  SELECT * FROM (
    SELECT {key}, lower(w) AS tok FROM {name}_w
    UNION ALL
    SELECT {key}, lower(unnest(parts)) AS tok FROM {name}_p WHERE len(parts) > 1)
  WHERE length(tok) > 1 AND tok NOT IN ({STOP}))"""


CORPUS = """
corpus0 AS (
  SELECT doc_id AS chunk_idx, 'src/' || source || '/' || lang || '/doc_' || doc_id || '.md' AS source_path,
         'doc' AS kind, upper(lang[1]) || lang[2:] || 'Doc.item_' || doc_id AS symbol,
         1 AS start_line, 1 + length(text) - length(replace(text, chr(10), '')) AS end_line, text
  FROM documents),
corpus AS (
  SELECT *, source_path || ':' || start_line || '-' || end_line || ':' || kind || ':' || symbol AS chunk_id
  FROM corpus0)"""

INDEXED = """
indexed AS (
  SELECT chunk_idx, source_path || ' ' || symbol || ' ' || symbol || ' ' || symbol || chr(10) || chr(10) || text AS body
  FROM corpus)"""

QUESTIONS = "questions AS (SELECT 'bm_' || item_id AS qid, text AS question FROM benchmark)"

NAMED_QUESTIONS = """
questions AS (
  SELECT 'bm_' || item_id AS qid, 'How does ' || symbol || ' work with: ' || b.text AS question
  FROM benchmark b JOIN corpus c ON c.chunk_idx = b.item_id)"""

# RE2 has no lookaround and an ASCII \b; the questions here are ASCII around names.
IDENT = (
    r"\b([A-Z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"
    r"|[A-Z][a-z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+"
    r"|[a-z_][a-z0-9_]*_[a-z0-9_]+)\b"
)

NAMES = f"""
names0 AS (SELECT qid, regexp_extract_all(question, '{IDENT}', 1) AS ids FROM questions),
names AS (SELECT qid, unnest(ids) AS name, generate_subscripts(ids, 1) - 1 AS pos FROM names0),
boosted AS (
  SELECT q.qid, q.question || ' ' || array_to_string(ids || ids || ids || ids || ids, ' ') AS question
  FROM questions q JOIN names0 n ON n.qid = q.qid)"""

SYMBOLS = """
symbols AS (
  SELECT DISTINCT chunk_idx, unnest([lower(symbol), lower(string_split(symbol, '.')[-1])]) AS key FROM corpus)"""

INJECT = """
inject AS (
  SELECT n.qid, s.chunk_idx, min(n.pos) AS pos
  FROM names n JOIN symbols s ON s.key = lower(n.name) GROUP BY 1, 2)"""


def scores(questions: str = "boosted", docs: str = "indexed", key: str = "chunk_idx", text: str = "body") -> str:
    """CTE scored(qid, chunk_idx, score) by BM25 with the floored idf."""
    return f"""{tokens('dtok', docs, key, text)},
{tokens('qtok', questions, 'qid', 'question')},
tf AS (SELECT {key}, tok, count(*) AS tf FROM dtok GROUP BY ALL),
dl AS (SELECT d.{key}, coalesce(sum(tf), 0) AS dl FROM {docs} d LEFT JOIN tf ON tf.{key} = d.{key} GROUP BY 1),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT tok, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, tot),
flo AS (SELECT 0.25 * avg(idf) AS eps, avg(idf) AS mean_idf, count(*) AS n_terms FROM raw),
idf AS (SELECT tok, CASE WHEN idf < 0 THEN eps ELSE idf END AS idf FROM raw, flo),
qtf AS (SELECT qid, tok, count(*) AS qtf FROM qtok GROUP BY ALL),
scored AS (
  SELECT q.qid, tf.{key} AS chunk_idx,
         sum(q.qtf * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / tot.avgdl))) AS score
  FROM qtf q JOIN idf ON idf.tok = q.tok JOIN tf ON tf.tok = q.tok JOIN dl ON dl.{key} = tf.{key}, tot
  GROUP BY 1, 2)"""


def keyword_leg(k: int) -> str:
    """CTE kleg(qid, rank, chunk_idx, score, injected): injected first, then by score."""
    return f"""
best AS (SELECT qid, CASE WHEN max(score) > 0 THEN max(score) ELSE 1.0 END AS best FROM scored GROUP BY 1),
both0 AS (
  SELECT coalesce(s.qid, i.qid) AS qid, coalesce(s.chunk_idx, i.chunk_idx) AS chunk_idx,
         coalesce(s.score, 0) AS score, i.pos
  FROM (SELECT * FROM scored WHERE score > 0) s
  FULL JOIN inject i ON i.qid = s.qid AND i.chunk_idx = s.chunk_idx),
kleg AS (
  SELECT * FROM (
    SELECT b.qid, row_number() OVER (PARTITION BY b.qid ORDER BY pos NULLS LAST,
             CASE WHEN pos IS NULL THEN -round(score, 9) END, chunk_idx) - 1 AS rank,
           chunk_idx, CASE WHEN pos IS NULL THEN score ELSE best + 100 END AS score, pos IS NOT NULL AS injected
    FROM both0 b JOIN best ON best.qid = b.qid) WHERE rank < {k})"""


VECTORS = """
cvec AS (SELECT vec_id AS chunk_idx, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
qvec AS (SELECT 'bm_' || item_id AS qid, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)"""


def vector_leg(k: int) -> str:
    """CTE vleg(qid, rank, chunk_idx, similarity)."""
    return f"""
sims AS (
  SELECT qid, chunk_idx, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity
  FROM qvec q, cvec c),
vleg AS (
  SELECT * FROM (
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_idx) - 1 AS rank,
           chunk_idx, similarity FROM sims) WHERE rank < {k})"""


def hybrid(k: int, pool: int, pin: bool = True) -> str:
    """CTE hyb(qid, rank, chunk_idx, score, source, pinned) from vleg and kleg."""
    budget = max(1, min(3, k // 3))
    wanted = f"irank < {budget} AND n_inj <= 5" if pin else "false"
    return f"""
fused AS (
  SELECT coalesce(v.qid, b.qid) AS qid, coalesce(v.chunk_idx, b.chunk_idx) AS chunk_idx,
         coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score,
         v.rank AS vrank, b.rank AS brank, CASE WHEN b.injected THEN b.rank END AS irank
  FROM vleg v FULL JOIN kleg b ON v.qid = b.qid AND v.chunk_idx = b.chunk_idx),
ninj AS (SELECT qid, count(irank) AS n_inj FROM fused GROUP BY 1),
pins AS (SELECT f.*, coalesce({wanted}, false) AS pinned FROM fused f JOIN ninj n ON n.qid = f.qid),
hyb AS (
  SELECT * FROM (
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC,
             CASE WHEN pinned THEN irank END NULLS LAST, round(score, 12) DESC,
             vrank NULLS LAST, brank NULLS LAST) - 1 AS rank,
           chunk_idx, score,
           concat_ws('+', CASE WHEN brank IS NOT NULL THEN 'bm25' END, CASE WHEN pinned THEN 'symbol' END,
                     CASE WHEN vrank IS NOT NULL THEN 'vector' END) AS source, pinned
    FROM pins) WHERE rank < {pool})"""
