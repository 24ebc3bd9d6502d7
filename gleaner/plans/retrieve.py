"""Retrieval methods put together from the operators, for many questions at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import hybrid, keyword
from gleaner.operators.joins import BROADCAST_BYTES, spread_small, stack
from gleaner.operators.keyword import KeywordIndex
from gleaner.operators.rerank import REMOTE_TEXT_CHARS, best_scored
from gleaner.operators.vector import nearest
from gleaner.operators.vector_index import VectorIndex
from gleaner.providers import OFFLINE, Providers, hyde_query
from gleaner.session import checkpointed

# Method names and what they stand for.
ALIASES = {
    "hybrid_rerank": {"rerank": True},
    "hybrid_hyde": {"hyde": True},
    "hybrid_rerank_hyde": {"rerank": True, "hyde": True},
    "hybrid_code_rerank": {"code_rerank": True},
}
BASES = ("vector", "bm25", "hybrid")
RETRIEVAL_METHODS = (*BASES, *ALIASES)
METHODS = (*RETRIEVAL_METHODS, "agentic", "routed")

META = ("chunk_id", "text", "source_path", "kind", "symbol", "start_line", "end_line")
HIT_ROW_BYTES = 160
# So many times the texts are read, before they are shuffled once instead.
PASSES = 16
# monotonically_increasing_id() counts rows in the low 33 bits.
BLOCK_ROW_BITS = 33


@dataclass(frozen=True)
class Method:
    base: str
    rerank: bool = False
    hyde: bool = False
    code_rerank: bool = False


def resolve(name: str, **flags: bool) -> Method:
    """A method name and additional flags; names that mean nothing else are hybrid."""
    base = name if name in BASES else "hybrid"
    method = replace(Method(base), **ALIASES.get(name, {}))
    return replace(method, **{flag: True for flag, on in flags.items() if on})


@dataclass(frozen=True)
class Corpus:
    """chunks(chunk_idx, chunk_id, text, source_path, kind, symbol, start_line, end_line),
    vectors(chunk_idx, embedding), the keyword index (or none), and an index over the vectors (or none).

    With `probes`, a vector search reads so many cells per question; without,
    as many as make it exact.
    """

    chunks: DataFrame
    vectors: DataFrame
    keywords: KeywordIndex | None
    cells: VectorIndex | None = None
    probes: int | None = None

    def nearest(self, question_vectors: DataFrame, k: int) -> DataFrame:
        if self.cells is None:
            return nearest(self.vectors, question_vectors, k)
        return self.cells.search(question_vectors, k, self.probes)[0]


def block_of(chunk_idx: Column) -> Column:
    """The stored block of a chunk: its ingest and the range partition it was written by."""
    return F.shiftright(chunk_idx, BLOCK_ROW_BITS)


def hydrate(hits: DataFrame, chunks: DataFrame, max_rows: int, row_bytes: int = HIT_ROW_BYTES) -> DataFrame:
    """Text and metadata of the ranked chunks; hits without a chunk are left out.

    At most `max_rows` hits exist, so their size is known before they are
    computed.  They go to the chunks, in batches of a size that is broadcast, and
    no text is shuffled.  Only beyond PASSES batches, when reading the texts so
    often costs more than moving them once, both sides meet by chunk, where
    adaptive execution splits a chunk that very many questions found.
    """
    key = ["chunk_idx"]
    if "block" in chunks.columns:
        # Stored chunks are partitioned by block: the join prunes the scan to
        # the blocks that hold hits, instead of reading every text.
        hits, key = hits.withColumn("block", block_of(F.col("chunk_idx"))), ["block", "chunk_idx"]
    texts = chunks.select(*key, *META)
    batches = min(max_rows, -(-max_rows * row_bytes // max(BROADCAST_BYTES, 1)))
    if batches <= 1:
        return texts.join(F.broadcast(hits), key).drop("block")
    if batches > PASSES:
        return texts.join(hits, key).drop("block")
    # A hash deals them unevenly: twice as many batches, each within the bound.
    ids = checkpointed(hits)
    parts = [ids.where(F.pmod(F.xxhash64("qid", "chunk_idx"), F.lit(2 * batches)) == i) for i in range(2 * batches)]
    return stack(*[texts.join(F.broadcast(part), key) for part in parts]).drop("block")


def _question_vectors(questions: DataFrame, providers: Providers, hyde: bool) -> DataFrame:
    text = hyde_query(providers, F.col("question")) if hyde else F.col("question")
    return questions.select("qid", providers.embed(text).alias("embedding"))


def ranked(
    questions: DataFrame,
    corpus: Corpus,
    k: int,
    method: Method,
    providers: Providers = OFFLINE,
    question_vectors: DataFrame | None = None,
) -> DataFrame:
    """Ranking by ids alone: (qid, rank, chunk_idx, score, source, pinned)."""
    tag = "vector+hyde" if method.hyde else "vector"
    if method.base == "bm25":
        if corpus.keywords is None:
            return questions.sparkSession.createDataFrame(
                [], "qid string, rank int, chunk_idx bigint, score double, source string, pinned boolean"
            )
        hits = keyword.keyword_search(questions, corpus.keywords, k)
        return hits.select("qid", "rank", "chunk_idx", "score", F.lit("bm25").alias("source"), F.lit(False).alias("pinned"))

    if question_vectors is None:
        question_vectors = _question_vectors(questions, providers, method.hyde)
    if method.base == "vector":
        hits = corpus.nearest(question_vectors, k)
        # The score is minus the cosine distance.
        return hits.select(
            "qid", "rank", "chunk_idx", (F.col("similarity") - 1.0).alias("score"),
            F.lit(tag).alias("source"), F.lit(False).alias("pinned"),
        )

    pool = hybrid.pool_size(k, method.rerank)
    fetch = hybrid.fetch_size(pool)
    near = corpus.nearest(question_vectors, fetch)
    if corpus.keywords is None:
        words = near.select("qid", "rank", "chunk_idx", F.lit(False).alias("injected"), F.lit(False).alias("searchable")).limit(0)
    else:
        words = keyword.keyword_leg(questions, corpus.keywords, fetch)
    return hybrid.pin_and_cut(hybrid.fuse(near, words, tag), k, pool)


def retrieve(
    questions: DataFrame,
    corpus: Corpus,
    k: int = 6,
    method: str = "hybrid",
    providers: Providers = OFFLINE,
    question_vectors: DataFrame | None = None,
    rerank_chars: int | None = REMOTE_TEXT_CHARS,
    **flags: bool,
) -> DataFrame:
    """questions(qid, question) -> hits
    (qid, rank, chunk_idx, score, source, rerank_score, + chunk text and metadata).

    The code re-ranker reads `rerank_chars` characters of a text, or all of it.
    """
    how = resolve(method, **flags)
    pool = hybrid.pool_size(k, how.rerank and how.base == "hybrid")
    asked = questions.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("question")), F.lit(0)).alias("bytes")).first()
    hits = ranked(questions, corpus, k, how, providers, question_vectors)
    scorers = []
    if how.base == "hybrid" and how.rerank:
        scorers.append((providers.rerank, "rerank", None))
    if how.base == "hybrid" and how.code_rerank:
        scorers.append((providers.code_rerank, "code", rerank_chars))
    if not scorers:
        hits = hydrate(hits, corpus.chunks, asked["n"] * pool).withColumn("rerank_score", F.lit(None).cast("double"))
        return hits.select("qid", "rank", "chunk_idx", "score", "source", "rerank_score", *META)
    # Texts come to the hits twice: to be scored where they are read, and for the k that are left.
    for scorer, tag, chars in scorers:
        with_question = hits.join(questions.select("qid", "question"), "qid")
        bound = HIT_ROW_BYTES + -(-asked["bytes"] // max(asked["n"], 1))
        texts = hydrate(with_question, spread_small(corpus.chunks), asked["n"] * pool, bound)
        hits, pool = checkpointed(best_scored(texts.select(*with_question.columns, "text"), k, scorer, tag, chars).drop("question")), k
    return hydrate(hits, corpus.chunks, asked["n"] * k).select("qid", "rank", "chunk_idx", "score", "source", "rerank_score", *META)
