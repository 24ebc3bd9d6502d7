"""Text queries: tokens, names, index text, routing, and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import retrieval, sql, views
from gleaner.functions import arrays, embedding, layout, replies, routing
from gleaner.functions import text as tx
from gleaner.operators import keyword


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.texts(spark, sf_dir, "documents")


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _documents(spark, sf_dir).select("doc_id", F.explode(arrays.counted(tx.tokens(F.col("text")), "token", "n")).alias("c"))
    return counts.select("doc_id", "c.token", big("c.n").alias("n"))


def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every word of path, symbol and text."""
    words = views.corpus(spark, sf_dir, spread=True).select(
        F.explode(F.regexp_extract_all(F.concat_ws(" ", "source_path", "symbol", "text"), F.lit(tx.WORD), F.lit(0))).alias("word")
    )
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(
        "word", F.array_join(tx.camel_parts(F.col("word")), "|").alias("parts"), "n"
    )


def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _mentions(spark, sf_dir).select("qid", F.posexplode(tx.identifiers(F.col("question"))).alias("pos", "name"))
    return names.select("qid", big("pos").alias("pos"), "name")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about every document: names its symbol, a snake and a camel form of it."""
    c = views.corpus(spark, sf_dir)
    return c.select(
        F.format_string("q_%d", "chunk_idx").alias("qid"),
        F.format_string(
            "Why does %s call make_item_%d in TaskItem%dRunner before %s?", "symbol", "chunk_idx", "chunk_idx", "symbol"
        ).alias("question"),
    )


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tx.index_text(F.col("text"), F.col("source_path"), F.col("symbol"))
    return views.corpus(spark, sf_dir, spread=True).select("chunk_idx", F.md5(body).alias("digest"), big(F.length(body)).alias("n_chars"))


def bm25_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.named_questions(spark, sf_dir)
    terms = asked.select("qid", F.explode(arrays.counted(tx.tokens(tx.boosted_question(F.col("question"))), "term", "qtf")).alias("t"))
    return terms.select("qid", "t.term", big("t.qtf").alias("qtf"))


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    forward = keyword.forward_index(views.corpus(spark, sf_dir, spread=True))
    return keyword.postings(forward).where("tf > 0").select(F.col("key").alias("term"), "chunk_idx", big("tf").alias("tf"), big("dl").alias("dl"))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.index(spark, sf_dir).totals.select(
        "n_docs",
        F.round("avgdl", 6).alias("avgdl"),
        "n_terms",
        F.round("mean_idf", 6).alias("mean_idf"),
        F.round("idf_floor", 6).alias("idf_floor"),
    )


def symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.symbol_table(views.corpus(spark, sf_dir))


def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = keyword.symbol_matches(_mentions(spark, sf_dir), views.corpus(spark, sf_dir))
    return hits.select("qid", "chunk_idx", big("pos").alias("pos"))


# How every conversation turn is worded as a question, by conv_id + turn.
WORDINGS = (
    "In what order do these run: ",
    "Trace the full path from ",
    "Show the end-to-end flow of ",
    "Which hooks fire and when: ",
    "Where is Foo.bar defined? ",
    "How does pool.slots behave: ",
    "Source code please: ",
    "What is the difference between this and that? ",
    "Compare a and b: ",
    "  what's a turn: ",
    "Why does it stop: ",
    "Explain how: ",
    "Lifecycle of ",
    "Anything about ",
)


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations")
    openings = F.array(*[F.lit(w) for w in WORDINGS])
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(WORDINGS))).cast("int")
    return turns.select("conv_id", "turn", F.concat(F.get(openings, which), "text").alias("question"))


def classify_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worded(spark, sf_dir).select("conv_id", "turn", routing.classify(F.col("question")).alias("question_type"))


def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = routing.method_for(routing.classify(F.col("question")))
    return _worded(spark, sf_dir).groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"))


def _escaped(text: Column) -> Column:
    for plain, quoted in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(quoted))
    return text


# Reply forms around the text of a conversation turn: (before, after, text is JSON-escaped).
VERDICT_FORMS = (
    ('{"score": 2, "reason": "', '"}', True),
    ('```json\n{"score": 7, "reason": "', '"}\n```', True),
    ('bad "score": 1 tail ', "", False),
    ("", "", False),
    ('{"score": "3", "reason": "', '"}', True),
    ('{"score": 2.7, "reason": "', '"}', True),
    ('{"reason": "', '"}', True),
    ('{"score": -1, "reason": "', '"}', True),
    ('{"score": null, "reason": "', '"}', True),
    ('  {"score": "2.5", "reason": "', '"}  ', True),
)
QUESTION_FORMS = (
    ('{"question": "', '", "category": "factual"}', True),
    ('```json\n{"question": "', '", "category": "where_is"}\n```', True),
    ('{"skip": true, "question": "', '", "category": "factual"}', True),
    ('{"question": "', '"}', True),
    ('{"question": "', '", "category": "other"}', True),
    ('{"question": "', '", "category": ', True),
    ('{"skip": false, "question": "', '", "category": "multi_hop"}', True),
    ('{"skip": 0, "question": "', '", "category": "conceptual"}', True),
    ("", "", False),
)
ANSWER_FORMS = (
    ("<INSUFFICIENT_CONTEXT>", "", None),
    (' \n"`<INSUFFICIENT_CONTEXT>`"', "", None),
    ("<INSUFFICIENT_CONTEXT> because ", "", False),
    ("", "", False),
    ("", " <INSUFFICIENT_CONTEXT>", False),
)


def replied(spark: SparkSession, sf_dir: str, forms: tuple) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations")
    text = {True: _escaped(F.col("text")), False: F.col("text"), None: F.lit("")}
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(forms)))
    reply = F.lit(None).cast("string")
    for n, (before, after, escaped) in enumerate(forms):
        reply = F.when(which == n, F.concat(F.lit(before), text[escaped], F.lit(after))).otherwise(reply)
    return turns.select("conv_id", "turn", reply.alias("reply"))


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = replied(spark, sf_dir, VERDICT_FORMS).select("conv_id", "turn", replies.parse_verdict(F.col("reply")).alias("v"))
    return verdict.select("conv_id", "turn", big("v.score").alias("score"), "v.reason")


def gen_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = replied(spark, sf_dir, QUESTION_FORMS).select("conv_id", "turn", replies.parse_question(F.col("reply")).alias("p"))
    return parsed.where("p IS NOT NULL").select("conv_id", "turn", "p.question", "p.category")


def insufficient_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replied(spark, sf_dir, ANSWER_FORMS).select("conv_id", "turn", replies.is_insufficient(F.col("reply")).alias("insufficient"))


def tool_args_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search calls of the event log; the event type goes in as the query of odd events."""
    events = views.table(spark, sf_dir, "events")
    query = F.concat(F.lit('{"query": "  '), "event_type", F.lit(' "}'))
    arguments = F.when(F.pmod(F.col("event_id"), F.lit(2)) == 0, F.col("props")).otherwise(query)
    parsed = events.select("event_id", replies.search_arguments(arguments).alias("a"))
    return parsed.select("event_id", "a.query", big("a.k").alias("k"))


def hyde_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.providers import OFFLINE, hyde_query

    asked = views.questions(spark, sf_dir)
    return asked.select("qid", hyde_query(OFFLINE, F.col("question")).alias("embedded_text"))


def embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _documents(spark, sf_dir).select("doc_id", F.posexplode(embedding.hashed_embedding(F.col("text"))).alias("bucket", "weight"))
    return vectors.where("weight <> 0").select("doc_id", big("bucket").alias("bucket"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


def citation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents keep path and lines; pages stand for tracker items."""
    docs = views.corpus(spark, sf_dir).select("source_path", "start_line", "end_line")
    pages = views.table(spark, sf_dir, "pages").select(
        F.format_string("_gh/site/%s/%d", F.when(F.col("page_id") % 2 == 1, "pr").otherwise("issues"), "page_id").alias("source_path"),
        F.lit(1).alias("start_line"),
        (views.newlines(F.col("html")) + 1).alias("end_line"),
    )
    return docs.unionByName(pages).select(
        "source_path", layout.citation(F.col("source_path"), F.col("start_line"), F.col("end_line"), "acme").alias("label")
    )


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, camel_split, extract_identifiers, enrich, bm25_boosted, bm25_postings, bm25_stats, symbol_map,
        symbol_lookup, classify_question, route_question, judge_parse, gen_parse, insufficient_flag,
        tool_args_parse, hyde_text, embed_hashed, citation_label,
    )
}

_MENTIONS = """
questions AS (
  SELECT 'q_' || chunk_idx AS qid, 'Why does ' || symbol || ' call make_item_' || chunk_idx || ' in TaskItem'
         || chunk_idx || 'Runner before ' || symbol || '?' AS question
  FROM corpus)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _forms(forms: tuple) -> str:
    escaped = r"""replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n')"""
    text = {True: escaped, False: "text", None: "''"}
    cases = " ".join(
        f"WHEN {n} THEN {_quote(before)} || {text[esc]} || {_quote(after)}" for n, (before, after, esc) in enumerate(forms)
    )
    return f"replies AS (SELECT conv_id, turn, CASE (conv_id + turn) % {len(forms)} {cases} END AS reply FROM conversations)"


_UNFENCED = r"""
clean AS (
  SELECT conv_id, turn, regexp_replace(trim(reply, ' ' || chr(9) || chr(10) || chr(13)), '(?m)^```(?:json)?\s*|\s*```$', '', 'g') AS txt
  FROM replies),
docs AS (SELECT *, TRY_CAST(txt AS JSON) AS j FROM clean)"""


def _any(patterns: tuple[str, ...], text: str = "question") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_ROUTED = f"""
worded AS (
  SELECT conv_id, turn, [{', '.join(_quote(w) for w in WORDINGS)}][(conv_id + turn) % {len(WORDINGS)} + 1] || text AS question
  FROM conversations),
typed AS (
  SELECT conv_id, turn, CASE
    WHEN {_any(routing.MULTI_HOP_PATTERNS)} THEN 'multi_hop'
    WHEN len(list_filter(regexp_extract_all(question, '{sql.IDENT}', 1), lambda x: contains(x, '.'))) > 0 THEN 'code'
    WHEN {_any(routing.CODE_PATTERNS)} THEN 'code'
    WHEN {_any(routing.CONCEPTUAL_PATTERNS)} THEN 'conceptual'
    ELSE 'code' END AS question_type
  FROM worded)"""

_TF = """
tf AS (SELECT chunk_idx, tok, count(*) AS tf FROM dtok GROUP BY ALL),
dl AS (SELECT i.chunk_idx, coalesce(sum(tf), 0) AS dl FROM indexed i LEFT JOIN tf ON tf.chunk_idx = i.chunk_idx GROUP BY 1)"""

ORACLES = {
    "tokenize": sql.ctes(sql.tokens("tok", "documents", "doc_id", "text"))
    + " SELECT doc_id, tok AS token, count(*) AS n FROM tok GROUP BY ALL",
    "camel_split": f"""{sql.ctes(sql.CORPUS)},
w AS (SELECT unnest(regexp_extract_all(source_path || ' ' || symbol || ' ' || text, '[A-Za-z0-9]+')) AS word FROM corpus)
SELECT word, array_to_string({sql.camel('word')}, '|') AS parts, count(*) AS n FROM w GROUP BY 1, 2""",
    "extract_identifiers": f"{sql.ctes(sql.CORPUS, _MENTIONS, sql.NAMES)} SELECT qid, pos, name FROM names",
    "enrich": f"{sql.ctes(sql.CORPUS, sql.INDEXED)} SELECT chunk_idx, md5(body) AS digest, length(body) AS n_chars FROM indexed",
    "bm25_boosted": sql.ctes(sql.CORPUS, sql.NAMED_QUESTIONS, sql.NAMES, sql.tokens("qt", "boosted", "qid", "question"))
    + " SELECT qid, tok AS term, count(*) AS qtf FROM qt GROUP BY ALL",
    "bm25_postings": sql.ctes(sql.CORPUS, sql.INDEXED, sql.tokens("dtok", "indexed", "chunk_idx", "body"), _TF)
    + " SELECT tok AS term, tf.chunk_idx, tf, dl::BIGINT AS dl FROM tf JOIN dl ON dl.chunk_idx = tf.chunk_idx",
    "bm25_stats": f"""{sql.ctes(sql.CORPUS, sql.INDEXED, sql.QUESTIONS, sql.scores("questions"))}
SELECT n AS n_docs, round(avgdl, 6) AS avgdl, n_terms, round(mean_idf, 6) AS mean_idf, round(eps, 6) AS idf_floor FROM tot, flo""",
    "symbol_map": f"{sql.ctes(sql.CORPUS, sql.SYMBOLS)} SELECT key, chunk_idx FROM symbols",
    "symbol_lookup": f"{sql.ctes(sql.CORPUS, _MENTIONS, sql.NAMES, sql.SYMBOLS, sql.INJECT)} SELECT qid, chunk_idx, pos FROM inject",
    "classify_question": f"{sql.ctes(_ROUTED)} SELECT conv_id, turn, question_type FROM typed",
    "route_question": f"""{sql.ctes(_ROUTED)}
SELECT CASE question_type WHEN 'multi_hop' THEN 'agentic' WHEN 'conceptual' THEN 'hybrid_hyde' ELSE 'hybrid' END AS method,
       count(*) AS n FROM typed GROUP BY 1""",
    "judge_parse": rf"""{sql.ctes(_forms(VERDICT_FORMS), _UNFENCED)},
typed AS (
  SELECT *, json_type(j, '$.score') AS t, json_extract_string(j, '$.score') AS s,
         regexp_extract(txt, '"score"\s*:\s*([0-3])', 1) AS d FROM docs),
num AS (
  SELECT *, CASE WHEN t = 'VARCHAR' THEN CASE WHEN regexp_matches(s, '^\s*[+-]?[0-9]+\s*$') THEN s::DOUBLE END
                 WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN s::DOUBLE END AS n FROM typed)
SELECT conv_id, turn, greatest(0, least(3, CASE WHEN n IS NOT NULL THEN trunc(n) WHEN d <> '' THEN d::DOUBLE ELSE 0 END))::BIGINT AS score,
       left(CASE WHEN n IS NOT NULL THEN json_extract_string(j, '$.reason') ELSE txt END, 300) AS reason
FROM num""",
    "gen_parse": f"""{sql.ctes(_forms(QUESTION_FORMS), _UNFENCED)}
SELECT conv_id, turn, json_extract_string(j, '$.question') AS question, json_extract_string(j, '$.category') AS category
FROM docs WHERE j IS NOT NULL AND coalesce(json_extract_string(j, '$.skip'), 'false') IN ('false', '0')
  AND json_extract_string(j, '$.question') IS NOT NULL
  AND json_extract_string(j, '$.category') IN ('factual', 'where_is', 'conceptual', 'multi_hop')""",
    "insufficient_flag": rf"""{sql.ctes(_forms(ANSWER_FORMS))}
SELECT conv_id, turn, starts_with(regexp_replace(reply, '^\s*[`''"]*', ''), '<INSUFFICIENT_CONTEXT>') AS insufficient FROM replies""",
    "tool_args_parse": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS query,
       CASE WHEN event_id % 2 = 0 THEN coalesce(json_extract_string(props, '$.k')::BIGINT, 5) ELSE 5 END AS k FROM events""",
    "hyde_text": """
SELECT 'bm_' || item_id AS qid,
       'The code that deals with this is described as follows. ' || text || chr(10) || chr(10) || text AS embedded_text FROM benchmark""",
    "embed_hashed": f"""{sql.ctes(sql.tokens("tok", "documents", "doc_id", "text"))},
b AS (SELECT doc_id, ('0x' || left(md5(tok), 8))::BIGINT % 64 AS bucket, count(*) AS n FROM tok GROUP BY ALL),
m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1)
SELECT b.doc_id, bucket, round((n / norm)::FLOAT::DOUBLE, 5) AS weight FROM b JOIN m ON m.doc_id = b.doc_id""",
    "citation_label": f"""{sql.ctes(sql.CORPUS)}
SELECT source_path, source_path || ':' || start_line || '-' || end_line AS label FROM corpus
UNION ALL
SELECT '_gh/site/' || CASE WHEN page_id % 2 = 1 THEN 'pr' ELSE 'issues' END || '/' || page_id,
       'https://github.com/acme/site/' || CASE WHEN page_id % 2 = 1 THEN 'pull' ELSE 'issues' END || '/' || page_id FROM pages""",
}
