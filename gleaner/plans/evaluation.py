"""Questions x methods x runs -> fact table -> summaries; and writing new questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import replies
from gleaner.functions.text import MODULE_SYMBOL
from gleaner.operators import sampling
from gleaner.operators.joins import stack
from gleaner.operators.metrics import CELL, evaluation_cells, score_cells
from gleaner.plans.answering import HIT, Planner, ask, shots, symbol_planner
from gleaner.plans.retrieve import RETRIEVAL_METHODS, Corpus
from gleaner.providers import OFFLINE, SOURCE_CHARS, Providers
from gleaner.session import checkpointed


def judged(answers: DataFrame, providers: Providers = OFFLINE) -> DataFrame:
    """+ judge_score, judge_reason; both null where the judge gave nothing."""
    replied = answers.withColumn("_reply", providers.judge(F.col("question"), F.col("answer")))
    verdict = F.when(F.col("_reply").isNotNull(), replies.parse_verdict(F.col("_reply")))
    return replied.withColumn("v", verdict).select(
        *answers.columns, F.col("v.score").alias("judge_score"), F.col("v.reason").alias("judge_reason")
    )


def evaluate(
    questions: DataFrame,
    corpus: Corpus,
    methods: list[str],
    k: int = 10,
    runs: int = 1,
    skip_judge: bool = False,
    providers: Providers = OFFLINE,
    planner: Planner = symbol_planner,
) -> DataFrame:
    """questions(qid, question, category, expected_paths, expected_symbols) -> facts, one row per (method, run, qid)."""
    cells = evaluation_cells(
        questions.select("qid", "question", "category", "expected_paths", "expected_symbols"), methods, runs
    )
    answers, hits = [], []
    asked = questions.select("qid", "question")
    for method in methods:
        if method in RETRIEVAL_METHODS:
            # Runs differ in the answer only; the hits are found once.
            given, once = shots(asked, corpus, k, method, providers, runs)
            found = [(got, once) for got in given]
        else:
            found = []
            for _ in range(runs):
                got, more = ask(asked, corpus, k, method, providers, planner)
                found.append((got, more.where("phase = 'final'")))
        for run, (got, seen) in enumerate(found):
            place = {"method": F.lit(method), "run": F.lit(run)}
            answers.append(got.select("qid", "question", "answer").withColumns(place))
            hits.append(seen.select(*HIT).withColumns(place))
    given = stack(*answers).select(*CELL, "question", "answer")
    if skip_judge:
        given = given.withColumn("judge_score", F.lit(None).cast("int")).withColumn("judge_reason", F.lit(None).cast("string"))
    else:
        given = checkpointed(judged(given, providers))
    facts = score_cells(cells, stack(*hits))
    # A cell that could not be answered is no fact.
    return facts.join(given.where("answer IS NOT NULL").drop("question"), list(CELL))


def generate_questions(chunks: DataFrame, n: int, seed: int = 42, providers: Providers = OFFLINE) -> DataFrame:
    """Up to n questions written about sampled chunks.

    Ids count the sampled chunks, so a rejected one leaves a gap.
    """
    sources = sampling.question_sources(chunks, n, seed)
    sources = checkpointed(sources)
    # Ids alone are numbered, n of them at most.
    order = [c.alias(f"_o{i}") for i, c in enumerate(sampling.shuffled_order(seed, "chunk_id"))]
    ids = sources.groupBy().agg(F.array_sort(F.collect_list(F.struct(*order, "chunk_id"))).alias("rows"))
    numbers = ids.select(F.posexplode("rows").alias("n", "r")).select("n", "r.chunk_id")
    numbered = sources.join(numbers, "chunk_id")
    reply = providers.ask_about(F.col("source_path"), F.col("kind"), F.col("symbol"), F.substring("text", 1, SOURCE_CHARS))
    written = checkpointed(numbered.withColumn("reply", reply))
    q = replies.parse_question(F.col("reply"))
    symbols = F.when((F.col("symbol") != "") & (F.col("symbol") != MODULE_SYMBOL), F.array("symbol")).otherwise(
        F.array().cast("array<string>")
    )
    return written.withColumn("q", q).where("q IS NOT NULL").select(
        F.format_string("gen_%04d", "n").alias("qid"),
        "q.question",
        "q.category",
        F.array("source_path").alias("expected_paths"),
        symbols.alias("expected_symbols"),
        F.col("chunk_id").alias("source_chunk_id"),
        F.concat(F.lit("auto-generated from chunk: "), "chunk_id").alias("notes"),
    )
