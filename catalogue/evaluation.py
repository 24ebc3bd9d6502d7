"""Hits with text, re-ranking, multi-hop search, metrics and summaries."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import retrieval, sql, views
from catalogue.texts import big
from gleaner.functions import replies, routing
from gleaner.operators import hybrid, keyword, metrics, summary
from gleaner.operators.joins import stack
from gleaner.operators.vector import nearest
from gleaner.plans import answering, evaluation, retrieve
from gleaner.plans.retrieve import Corpus
from gleaner.providers import OFFLINE
from gleaner.session import checkpointed

K = 6
DEPTH = 10
RUNS = 3
METHODS = ("bm25", "vector", "hybrid")


def _corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(views.corpus(spark, sf_dir), views.corpus_vectors(spark, sf_dir), retrieval.index(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str, k: int, method: str) -> DataFrame:
    return retrieve.retrieve(
        views.named_questions(spark, sf_dir), _corpus(spark, sf_dir), k, method,
        question_vectors=views.question_vectors(spark, sf_dir),
    )


def hydrate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, K, "hybrid").select(
        "qid", big("rank").alias("rank"), "chunk_id", "source_path", "symbol", "source", F.md5("text").alias("digest")
    )


def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.contexts(_hits(spark, sf_dir, K, "hybrid")).select(
        "qid", F.md5("context").alias("digest"), big(F.length("context")).alias("n_chars")
    )


def format_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, K, "hybrid").withColumn("turn", F.lit(0)).withColumn("call", F.lit(0))
    return answering.previews(hits).select("qid", "listing")


def _reranked(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return _hits(spark, sf_dir, K, method).select(
        "qid", big("rank").alias("rank"), "chunk_idx", F.round("rerank_score", 6).alias("rerank_score"), "source"
    )


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, "hybrid_rerank")


def rerank_nowiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, "hybrid_code_rerank")


def hybrid_hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothetical answers and documents, both embedded by hashed terms."""
    from gleaner.functions.embedding import hashed_embedding

    corpus = views.corpus(spark, sf_dir, spread=True)
    vectors = corpus.select("chunk_idx", hashed_embedding(F.col("text")).alias("embedding"))
    hits = retrieve.ranked(
        views.named_questions(spark, sf_dir),
        Corpus(corpus, vectors, retrieval.index(spark, sf_dir)),
        K,
        retrieve.resolve("hybrid_hyde"),
    )
    return hits.select("qid", big("rank").alias("rank"), "chunk_idx", F.round("score", 9).alias("score"), "source")


_hashed_vectors: dict[tuple[str, str], DataFrame] = {}


def _hashed_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """All documents with the vectors that the offline provider gives them, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _hashed_vectors:
        texts = views.corpus(spark, sf_dir, spread=True)
        _hashed_vectors[key] = checkpointed(texts.select("chunk_idx", OFFLINE.embed(F.col("text")).alias("embedding")))
    return Corpus(views.corpus(spark, sf_dir), _hashed_vectors[key], retrieval.index(spark, sf_dir))


def agentic_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-hop search as it runs: each question, then the symbol of its best hit."""
    _, hits = answering.agentic(views.named_questions(spark, sf_dir), _hashed_corpus(spark, sf_dir))
    return hits.select("qid", big("turn").alias("turn"), big("rank").alias("rank"), "chunk_idx", "source")


def _typed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all kinds, and a third that finds nothing."""
    n = F.regexp_extract("qid", r"(\d+)", 1).cast("long")
    symbol = F.regexp_extract("question", r"How does (\S+) work", 1)
    lead = F.when(n % 3 == 0, F.concat(F.lit("zqxj"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("In what order is "), symbol, F.lit(" set up?")))
    return views.named_questions(spark, sf_dir).withColumn("question", F.coalesce(lead, F.col("question")))


def ask_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed answers as they are given: single shots, multi-hop searches, and second chances.

    The provider is never sure of questions that consist of an unknown word.
    """
    corpus = _hashed_corpus(spark, sf_dir)
    unsure = replace(OFFLINE, answer=lambda q, c: F.when(q.startswith("zqxj"), F.lit(replies.INSUFFICIENT)).otherwise(OFFLINE.answer(q, c)))
    answers, hits = answering.ask(_typed_questions(spark, sf_dir), corpus, K, "routed", unsure)
    seen = hits.groupBy("qid").agg(
        F.count_if(F.col("phase") == "final").alias("n_final"), F.count_if(F.col("phase") == "first").alias("n_first")
    )
    return answers.join(seen, "qid", "left").select(
        "qid", "routed_to", "used_fallback", big("turns").alias("turns"), F.md5("answer").alias("digest"), "n_final", "n_first"
    )


def evaluate_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation as it runs: retrieval, answers, judge and metrics of every method, run and question."""
    questions = views.named_questions(spark, sf_dir).join(_labelled(spark, sf_dir).drop("judge_score"), "qid")
    facts = evaluation.evaluate(questions, _hashed_corpus(spark, sf_dir), list(METHODS), DEPTH, RUNS)
    return facts.select(
        *_keys(), "category", F.round("mrr", 6).alias("mrr"), F.round("p_mrr", 6).alias("p_mrr"),
        F.round("path_coverage", 6).alias("path_coverage"), big("judge_score").alias("judge_score"),
        F.array_join("hit_paths", "|").alias("hit_paths"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with expectations: some have no path, no symbol, or a null symbol list."""
    items = views.table(spark, sf_dir, "benchmark").select("item_id")
    docs = views.corpus(spark, sf_dir).select(F.col("chunk_idx").alias("item_id"), "source_path", "symbol")
    verdicts = views.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), (F.col("quality") + 2 * F.col("toxic")).alias("judge_score")
    )
    n = F.col("item_id")
    none = F.array().cast("array<string>")
    categories = F.array(*[F.lit(c) for c in replies.CATEGORIES])
    return (
        items.join(docs, "item_id")
        .join(verdicts, "item_id", "left")
        .select(
            F.format_string("bm_%d", n).alias("qid"),
            F.get(categories, (n % 4).cast("int")).alias("category"),
            F.when(n % 5 == 0, none)
            .when(n % 5 == 1, F.array("source_path", F.format_string("/doc_%d.md", n + 1), F.lit("src/src1/")))
            .otherwise(F.array("source_path", F.lit("no/such_path")))
            .alias("expected_paths"),
            F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, none).otherwise(F.array("symbol", F.lit("Doc.item_1"))).alias("expected_symbols"),
            "judge_score",
        )
    )


def _method_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 of three methods with metadata, the same in every run."""
    # The long legs of the hybrid method contain the hits of the other two;
    # all three read the same shuffles.
    asked, corpus = views.named_questions(spark, sf_dir), _corpus(spark, sf_dir)
    fetch = hybrid.fetch_size(DEPTH)
    words = keyword.keyword_leg(asked, corpus.keywords, fetch)
    near = nearest(corpus.vectors, views.question_vectors(spark, sf_dir), fetch)
    legs = {
        "bm25": words.where(F.col("searchable") & (F.col("rank") < DEPTH)),
        "vector": near.where(F.col("rank") < DEPTH),
        "hybrid": hybrid.pin_and_cut(hybrid.fuse(near, words), DEPTH, DEPTH),
    }
    ranked = stack(*[hits.select("qid", "rank", "chunk_idx", F.lit(m).alias("method")) for m, hits in legs.items()])
    meta = corpus.chunks.select("chunk_idx", "source_path", "symbol")
    bound = asked.count() * DEPTH * len(METHODS)
    if bound * retrieve.HIT_ROW_BYTES <= retrieve.BROADCAST_BYTES:
        ranked = F.broadcast(ranked)
    hits = meta.join(ranked, "chunk_idx")
    return hits.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Runs differ in what the judge says.
    cells = metrics.evaluation_cells(_labelled(spark, sf_dir), list(METHODS), RUNS).withColumn(
        "judge_score", ((F.col("judge_score") + F.col("run")) % 4).cast("int")
    )
    return metrics.score_cells(cells, _method_hits(spark, sf_dir))


KEYS = ("method", "run", "qid")


def _keys() -> list:
    return ["method", big("run").alias("run"), "qid"]


def hit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = metrics.hit_flags(_method_hits(spark, sf_dir).join(_labelled(spark, sf_dir), "qid"))
    return flagged.select(*_keys(), big("rank").alias("rank"), "path_hit", "strict_hit")


def strict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select(
        *_keys(), *[big(f"hit_at_{n}").alias(f"hit_at_{n}") for n in (1, 3, 10)], F.round("mrr", 6).alias("mrr"),
        big("num_hits_in_topk").alias("num_hits_in_topk"),
    )


def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select(
        *_keys(), *[big(f"p_hit_at_{n}").alias(f"p_hit_at_{n}") for n in (1, 3, 10)], F.round("p_mrr", 6).alias("p_mrr")
    )


def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select(
        *_keys(), F.round("path_coverage", 6).alias("path_coverage"), F.round("symbol_coverage", 6).alias("symbol_coverage")
    )


def eval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select(
        *_keys(), "category", F.round("mrr", 6).alias("mrr"), F.round("p_mrr", 6).alias("p_mrr"),
        big("judge_score").alias("judge_score"), F.array_join("hit_paths", "|").alias("hit_paths"),
    )


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_method(_facts(spark, sf_dir), rounded=False)


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def agg_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(_summary(spark, sf_dir))


def agg_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(summary.by_category(_facts(spark, sf_dir), rounded=False))


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(summary.scorecard(_summary(spark, sf_dir), summary.PATH_CARD))


def scorecard_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(summary.scorecard(_summary(spark, sf_dir), summary.STRICT_CARD))


def agentic_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of a conversation is one search of its multi-hop walk."""
    turns = views.table(spark, sf_dir, "conversations").where("role = 'user'")
    searches = turns.select(F.format_string("%d/%d", "conv_id", "turn").alias("qid"), F.col("text").alias("question"), "conv_id", "turn")
    hits = keyword.keyword_search(searches, retrieval.index(spark, sf_dir), replies.SEARCH_K)
    placed = hits.join(searches.select("qid", "conv_id", "turn"), "qid").select(
        F.col("conv_id").alias("qid"), "turn", F.lit(0).alias("call"), "rank", "chunk_idx"
    )
    return answering.cumulative(placed).select(
        F.col("qid").alias("conv_id"), "turn", big("rank").alias("rank"), "chunk_idx"
    )


def routed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each conversation turn ends up once insufficient single shots escalate."""
    from catalogue import texts

    asked = texts._worded(spark, sf_dir)
    route = routing.method_for(routing.classify(F.col("question")))
    answers = texts.replied(spark, sf_dir, texts.ANSWER_FORMS)
    both = asked.join(answers, ["conv_id", "turn"]).select(
        "conv_id", "turn", route.alias("route"), replies.is_insufficient(F.col("reply")).alias("insufficient")
    )
    escalates = (F.col("route") != "agentic") & F.col("insufficient")
    return both.select(
        "conv_id", "turn", escalates.alias("used_fallback"),
        F.when(escalates, F.concat("route", F.lit(" → agentic"))).otherwise(F.col("route")).alias("routed_to"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        hydrate_join, format_context, format_preview, rerank_overlap, rerank_nowiden, hybrid_hyde, hit_flags,
        strict_metrics, path_metrics, coverage_metrics, eval_matrix, agg_by_method, agg_by_category, scorecard,
        scorecard_strict, agentic_cumulative, routed_fallback, agentic_walk, ask_routed, evaluate_offline,
    )
}

_HYBRID = retrieval.named_hybrid(K, K, 60)
_SHOWN = "shown AS (SELECT h.*, c.chunk_id, c.source_path, c.symbol, c.kind, c.start_line, c.end_line, c.text FROM hyb h JOIN corpus c ON c.chunk_idx = h.chunk_idx)"


def _rerank(pool: int, fetch: int, tag: str, text: str) -> str:
    return f"""{retrieval.named_hybrid(K, pool, fetch)},
{sql.tokens("rq", "questions", "qid", "question")},
cand AS (SELECT chunk_idx, {text} AS body FROM corpus WHERE chunk_idx IN (SELECT chunk_idx FROM hyb)),
{sql.tokens("rd", "cand", "chunk_idx", "body")},
asked AS (SELECT DISTINCT qid, tok FROM rq),
has AS (SELECT DISTINCT chunk_idx, tok FROM rd),
many AS (SELECT qid, count(*) AS n FROM asked GROUP BY 1),
common AS (
  SELECT h.qid, h.chunk_idx, count(*) AS m FROM hyb h JOIN asked a ON a.qid = h.qid JOIN has d ON d.chunk_idx = h.chunk_idx AND d.tok = a.tok GROUP BY 1, 2),
rs AS (
  SELECT h.*, CASE WHEN NOT pinned THEN coalesce(m, 0) / n::DOUBLE END AS rerank_score
  FROM hyb h JOIN many ON many.qid = h.qid LEFT JOIN common c ON c.qid = h.qid AND c.chunk_idx = h.chunk_idx),
ro AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, round(rerank_score, 9) DESC NULLS LAST, rank) - 1 AS place FROM rs)
SELECT qid, place AS rank, chunk_idx, round(rerank_score, 6) AS rerank_score,
       CASE WHEN pinned THEN source ELSE source || '+{tag}' END AS source FROM ro WHERE place < {K}"""


def _hashed(body: str, k: int) -> str:
    """CTE vleg from hashed term counts of questions and documents."""
    return f"""
htext AS (SELECT qid, {body} AS body FROM questions),
{sql.tokens("ht", "htext", "qid", "body")},
{sql.tokens("ct", "corpus", "chunk_idx", "text")},
hb AS (SELECT qid, ('0x' || left(md5(tok), 8))::BIGINT % 64 AS b, count(*) AS n FROM ht GROUP BY ALL),
cb AS (SELECT chunk_idx, ('0x' || left(md5(tok), 8))::BIGINT % 64 AS b, count(*) AS n FROM ct GROUP BY ALL),
hn AS (SELECT qid, sqrt(sum(n * n)) AS norm FROM hb GROUP BY 1),
cn AS (SELECT chunk_idx, sqrt(sum(n * n)) AS norm FROM cb GROUP BY 1),
hw AS (SELECT hb.qid, b, (n / norm)::FLOAT::DOUBLE AS w FROM hb JOIN hn ON hn.qid = hb.qid),
cw AS (SELECT cb.chunk_idx, b, (n / norm)::FLOAT::DOUBLE AS w FROM cb JOIN cn ON cn.chunk_idx = cb.chunk_idx),
hl AS (SELECT qid, sqrt(sum(w * w)) AS l FROM hw GROUP BY 1),
cl AS (SELECT chunk_idx, sqrt(sum(w * w)) AS l FROM cw GROUP BY 1),
dots AS (SELECT qid, chunk_idx, sum(hw.w * cw.w) AS dot FROM hw JOIN cw ON cw.b = hw.b GROUP BY 1, 2),
sims AS (
  SELECT hl.qid, c.chunk_idx, round(coalesce(dot / (hl.l * cl.l), 0), 9) AS similarity
  FROM hl CROSS JOIN corpus c LEFT JOIN cl ON cl.chunk_idx = c.chunk_idx
  LEFT JOIN dots d ON d.qid = hl.qid AND d.chunk_idx = c.chunk_idx),
vleg AS (
  SELECT * FROM (
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_idx) - 1 AS rank, chunk_idx, similarity
    FROM sims) WHERE rank < {k})"""


_SUPPOSED = "'The code that deals with this is described as follows. ' || question || chr(10) || chr(10) || question"


def _eval(hybrid_hits: str) -> str:
    return f"""{hybrid_hits},
labelled AS (
  SELECT 'bm_' || item_id AS qid, ['factual', 'where_is', 'conceptual', 'multi_hop'][item_id % 4 + 1] AS category,
         CASE item_id % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [source_path, '/doc_' || (item_id + 1) || '.md', 'src/src1/']
              ELSE [source_path, 'no/such_path'] END AS paths,
         CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] ELSE [symbol, 'Doc.item_1'] END AS syms,
         quality + 2 * toxic AS judge_score
  FROM benchmark JOIN corpus ON chunk_idx = item_id LEFT JOIN labels l ON l.doc_id = item_id),
ranked AS (
  SELECT 'bm25' AS method, qid, rank, chunk_idx FROM kleg WHERE rank < {DEPTH}
  UNION ALL SELECT 'vector', qid, rank, chunk_idx FROM vleg WHERE rank < {DEPTH}
  UNION ALL SELECT 'hybrid', qid, rank, chunk_idx FROM hyb),
seen AS (
  SELECT method, run, qid, rank, source_path, symbol
  FROM ranked r JOIN corpus c ON c.chunk_idx = r.chunk_idx, (SELECT unnest(range({RUNS})) AS run)),
flags AS (
  SELECT s.*, len(list_filter(paths, lambda p: contains(source_path, p))) > 0 AS path_hit,
         len(list_filter(paths, lambda p: contains(source_path, p))) > 0
           AND (coalesce(len(syms), 0) = 0 OR len(list_filter(syms, lambda p: contains(symbol, p))) > 0) AS strict_hit
  FROM seen s JOIN labelled l ON l.qid = s.qid),
cells AS (
  SELECT m.method, r.run, l.* REPLACE ((l.judge_score + r.run) % 4 AS judge_score) FROM labelled l, (SELECT unnest(['bm25', 'vector', 'hybrid']) AS method) m, (SELECT unnest(range({RUNS})) AS run) r),
firsts AS (
  SELECT method, run, qid, min(rank) FILTER (strict_hit) AS s, min(rank) FILTER (path_hit) AS p, count(*) FILTER (strict_hit) AS hits,
         string_agg(source_path, '|' ORDER BY rank) AS hit_paths FROM flags GROUP BY ALL),
pc AS (
  SELECT method, run, qid, count(*) AS wanted, count(*) FILTER (found) AS got FROM (
    SELECT c.method, c.run, c.qid, i, bool_or(coalesce(contains(s.source_path, c.paths[i]), false)) AS found
    FROM (SELECT method, run, qid, paths, unnest(range(1, len(paths) + 1)) AS i FROM cells) c
    LEFT JOIN seen s ON s.method = c.method AND s.run = c.run AND s.qid = c.qid GROUP BY ALL) GROUP BY ALL),
sc AS (
  SELECT method, run, qid, count(*) AS wanted, count(*) FILTER (found) AS got FROM (
    SELECT c.method, c.run, c.qid, i, bool_or(coalesce(contains(s.symbol, c.syms[i]), false)) AS found
    FROM (SELECT method, run, qid, syms, unnest(range(1, len(syms) + 1)) AS i FROM cells) c
    LEFT JOIN seen s ON s.method = c.method AND s.run = c.run AND s.qid = c.qid GROUP BY ALL) GROUP BY ALL),
facts AS (
  SELECT c.method, c.run, c.qid, c.category, c.judge_score,
         coalesce(s < 1, false)::BIGINT AS hit_at_1, coalesce(s < 3, false)::BIGINT AS hit_at_3, coalesce(s < 10, false)::BIGINT AS hit_at_10,
         coalesce(1.0 / (s + 1), 0)::DOUBLE AS mrr, coalesce(hits, 0) AS num_hits_in_topk,
         coalesce(p < 1, false)::BIGINT AS p_hit_at_1, coalesce(p < 3, false)::BIGINT AS p_hit_at_3, coalesce(p < 10, false)::BIGINT AS p_hit_at_10,
         coalesce(1.0 / (p + 1), 0)::DOUBLE AS p_mrr,
         coalesce(pc.got / pc.wanted::DOUBLE, 1.0) AS path_coverage, coalesce(sc.got / sc.wanted::DOUBLE, 1.0) AS symbol_coverage,
         coalesce(hit_paths, '') AS hit_paths
  FROM cells c LEFT JOIN firsts f ON f.method = c.method AND f.run = c.run AND f.qid = c.qid
  LEFT JOIN pc ON pc.method = c.method AND pc.run = c.run AND pc.qid = c.qid
  LEFT JOIN sc ON sc.method = c.method AND sc.run = c.run AND sc.qid = c.qid)"""


_EVAL = _eval(retrieval.named_hybrid(DEPTH, DEPTH, 100))
_EVAL_HASHED = _eval(",\n".join((retrieval.NAMED, sql.keyword_leg(100), _hashed("question", 100), sql.hybrid(DEPTH, DEPTH))))
# Every question, and every symbol that a walk may search next.
_WALKED = retrieval.NAMED.replace(
    sql.NAMED_QUESTIONS.strip(),
    sql.NAMED_QUESTIONS.strip().replace("questions AS", "given AS", 1)
    + ",\nquestions AS (SELECT * FROM given UNION ALL SELECT 'symbol:' || symbol, symbol FROM corpus)",
)
_WALK = (
    ",\n".join((_WALKED.replace("WITH", "WITH RECURSIVE", 1), sql.keyword_leg(60), _hashed("question", 60), sql.hybrid(5, 5)))
    + """,
lead AS (SELECT qid, symbol FROM hyb JOIN corpus c ON c.chunk_idx = hyb.chunk_idx WHERE rank = 0),
walk AS (
  SELECT qid, 0 AS turn, qid AS query, []::VARCHAR[] AS seen FROM given
  UNION ALL
  SELECT w.qid, turn + 1, 'symbol:' || symbol, list_append(seen, symbol) FROM walk w JOIN lead ON lead.qid = w.query
  WHERE turn < 4 AND symbol <> '' AND NOT list_contains(seen, symbol))"""
)

_ASKED = (
    _WALK.replace("given AS", "plain AS", 1)
    .replace(
        "questions AS (SELECT * FROM given",
        r"""given AS (
  SELECT qid, CASE n % 3 WHEN 0 THEN 'zqxj' || n WHEN 1 THEN 'In what order is ' || symbol || ' set up?' ELSE question END AS question, n % 3 AS form
  FROM (SELECT *, regexp_extract(qid, '\d+')::BIGINT AS n, regexp_extract(question, 'How does (\S+) work', 1) AS symbol FROM plain)),
questions AS (SELECT qid, question FROM given""",
        1,
    )
    + ","
    + re.sub(r"\b(fused|ninj|pins|hyb)\b", r"\1_shot", sql.hybrid(K, K))
    + f""",
agent AS (
  SELECT w.qid, turn, chunk_idx, row_number() OVER (PARTITION BY w.qid ORDER BY turn, rank) AS place
  FROM walk w JOIN given g ON g.qid = w.qid AND form < 2 JOIN hyb ON hyb.qid = w.query),
listed AS (
  SELECT qid, max(turn) AS last, count(*) AS n,
         string_agg('[' || place || '] ' || source_path || ':' || start_line || '-' || end_line || ' (' || kind || ' · ' || symbol || ')'
           || chr(10) || '    ' || replace(substr(text, 1, 400), chr(10), ' '), chr(10) || chr(10) ORDER BY place) AS listing
  FROM agent a JOIN corpus c ON c.chunk_idx = a.chunk_idx GROUP BY 1),
shown AS (
  SELECT qid, '[#1] ' || source_path || ' (lines ' || start_line || '-' || end_line || ', ' || kind || ', ' || symbol || ')' || chr(10) || text AS block
  FROM hyb_shot h JOIN corpus c ON c.chunk_idx = h.chunk_idx WHERE rank = 0),
shots AS (SELECT qid, count(*) AS n FROM hyb_shot GROUP BY 1)
SELECT g.qid, ['hybrid → agentic', 'agentic', 'hybrid'][form + 1] AS routed_to, form = 0 AS used_fallback,
       CASE WHEN form < 2 THEN least(last + 2, 5) END::BIGINT AS turns,
       md5(CASE form WHEN 0 THEN '{replies.INSUFFICIENT}' WHEN 1 THEN listing ELSE block END) AS digest,
       CASE WHEN form < 2 THEN l.n ELSE s.n END AS n_final, CASE WHEN form = 0 THEN s.n ELSE 0 END AS n_first
FROM given g LEFT JOIN listed l ON l.qid = g.qid LEFT JOIN shown ON shown.qid = g.qid LEFT JOIN shots s ON s.qid = g.qid"""
)

_BY_RUN = "runs AS (SELECT method, run, count(*) AS n, " + ", ".join(f"avg({m}) AS {m}" for m in metrics.FACT_METRICS) + " FROM facts GROUP BY ALL)"


def _mean_std(names: tuple[str, ...]) -> str:
    parts = []
    for m in names:
        mean, std = f"coalesce(avg({m}), 0)", f"coalesce(stddev_samp({m}), 0)"
        if m == "judge_score":
            mean, std = f"nullif({mean}, 0)", f"CASE WHEN {mean} <> 0 THEN {std} END"
        parts += [f"round({mean}, 6) AS {m}_mean", f"round({std}, 6) AS {m}_std"]
    return ", ".join(parts)


def _by_method(names: tuple[str, ...]) -> str:
    return f"{_EVAL},\n{_BY_RUN}\nSELECT method, (sum(n) // count(*))::BIGINT AS n_questions, count(*) AS n_runs, {_mean_std(names)} FROM runs GROUP BY 1"


def _sql_texts():
    from catalogue import texts

    return texts


ORACLES = {
    "hydrate_join": f"{_HYBRID},\n{_SHOWN}\nSELECT qid, rank, chunk_id, source_path, symbol, source, md5(text) AS digest FROM shown",
    "format_context": f"""{_HYBRID},
{_SHOWN},
ctx AS (
  SELECT qid, string_agg('[#' || (rank + 1) || '] ' || source_path || ' (lines ' || start_line || '-' || end_line || ', ' || kind || ', ' || symbol || ')'
         || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM shown GROUP BY 1)
SELECT qid, md5(context) AS digest, length(context) AS n_chars FROM ctx""",
    "format_preview": f"""{_HYBRID},
{_SHOWN}
SELECT qid, string_agg('[' || (rank + 1) || '] ' || source_path || ':' || start_line || '-' || end_line || ' (' || kind || ' · ' || symbol || ')'
       || chr(10) || '    ' || replace(substr(text, 1, 400), chr(10), ' '), chr(10) || chr(10) ORDER BY rank) AS listing FROM shown GROUP BY 1""",
    "rerank_overlap": _rerank(30, 300, "rerank", "text"),
    "rerank_nowiden": _rerank(6, 60, "code", "substr(text, 1, 4000)"),
    "agentic_walk": f"""{_WALK}
SELECT w.qid, turn::BIGINT AS turn, row_number() OVER (PARTITION BY w.qid ORDER BY turn, rank) - 1 AS rank, chunk_idx, source
FROM walk w JOIN hyb ON hyb.qid = w.query""",
    "ask_routed": _ASKED,
    "evaluate_offline": f"""{_EVAL_HASHED}
SELECT method, run, qid, category, round(mrr, 6) AS mrr, round(p_mrr, 6) AS p_mrr, round(path_coverage, 6) AS path_coverage,
       (CASE WHEN hit_paths <> '' THEN 2 ELSE 1 END)::BIGINT AS judge_score, hit_paths FROM facts""",
    "hybrid_hyde": ",\n".join((retrieval.NAMED, sql.keyword_leg(60), _hashed(_SUPPOSED, 60), sql.hybrid(6, 6)))
    + "\nSELECT qid, rank, chunk_idx, round(score, 9) AS score, replace(source, 'vector', 'vector+hyde') AS source FROM hyb",
    "hit_flags": f"{_EVAL} SELECT method, run, qid, rank, path_hit, strict_hit FROM flags",
    "strict_metrics": f"{_EVAL} SELECT method, run, qid, hit_at_1, hit_at_3, hit_at_10, round(mrr, 6) AS mrr, num_hits_in_topk FROM facts",
    "path_metrics": f"{_EVAL} SELECT method, run, qid, p_hit_at_1, p_hit_at_3, p_hit_at_10, round(p_mrr, 6) AS p_mrr FROM facts",
    "coverage_metrics": f"{_EVAL} SELECT method, run, qid, round(path_coverage, 6) AS path_coverage, round(symbol_coverage, 6) AS symbol_coverage FROM facts",
    "eval_matrix": f"""{_EVAL}
SELECT method, run, qid, category, round(mrr, 6) AS mrr, round(p_mrr, 6) AS p_mrr, judge_score::BIGINT AS judge_score, hit_paths FROM facts""",
    "agg_by_method": _by_method(metrics.FACT_METRICS),
    "agg_by_category": f"""{_EVAL}
SELECT method, category, count(*) // count(DISTINCT run) AS n, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(mrr), 6) AS mrr,
       round(avg(path_coverage), 6) AS path_coverage FROM facts GROUP BY ALL""",
    "scorecard": _by_method(summary.PATH_CARD),
    "scorecard_strict": _by_method(summary.STRICT_CARD),
    "agentic_cumulative": f"""{sql.ctes(sql.CORPUS, sql.INDEXED)},
questions AS (SELECT conv_id || '/' || turn AS qid, conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
{sql.scores("questions")},
top AS (
  SELECT * FROM (
    SELECT qid, chunk_idx, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_idx) - 1 AS rank FROM scored WHERE score > 0)
  WHERE rank < 5)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, rank) - 1 AS rank, chunk_idx
FROM top JOIN questions q ON q.qid = top.qid""",
    "routed_fallback": _sql_texts().ORACLES["classify_question"].replace(
        "SELECT conv_id, turn, question_type FROM typed",
        ", " + _sql_texts()._forms(_sql_texts().ANSWER_FORMS) + r""",
merged AS (
  SELECT t.conv_id, t.turn, CASE question_type WHEN 'multi_hop' THEN 'agentic' WHEN 'conceptual' THEN 'hybrid_hyde' ELSE 'hybrid' END AS route,
         starts_with(regexp_replace(reply, '^\s*[`''"]*', ''), '<INSUFFICIENT_CONTEXT>') AS short
  FROM typed t JOIN replies r ON r.conv_id = t.conv_id AND r.turn = t.turn)
SELECT conv_id, turn, route <> 'agentic' AND short AS used_fallback,
       CASE WHEN route <> 'agentic' AND short THEN route || ' → agentic' ELSE route END AS routed_to FROM merged""",
    ),
}
