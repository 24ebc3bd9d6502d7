"""Model calls as column functions.

Every call a model may answer is a function of columns, so a model enters as a
pandas UDF and runs on the executors next to the data.  OFFLINE needs no model
and no network and gives the same answer every time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.embedding import hashed_embedding
from gleaner.functions.layout import BLOCK_RULE
from gleaner.functions.replies import INSUFFICIENT
from gleaner.operators.rerank import Scorer, overlap_scorer

SOURCE_CHARS = 1500


def _first_block(question: Column, context: Column) -> Column:
    """Quote the first snippet, or admit that there is none."""
    first = F.get(F.split(context, BLOCK_RULE), F.lit(0))
    return F.when(context == "", F.lit(INSUFFICIENT)).otherwise(first)


def _supposed_answer(question: Column) -> Column:
    return F.concat(F.lit("The code that deals with this is described as follows. "), question)


def _cited_verdict(question: Column, answer: Column) -> Column:
    score = F.when(F.contains(answer, F.lit("[#")), 2).otherwise(1)
    return F.to_json(F.struct(score.alias("score"), F.lit("cites a source or not").alias("reason")))


def _question_about(path: Column, kind: Column, symbol: Column, text: Column) -> Column:
    return F.to_json(
        F.struct(F.concat(F.lit("How does "), symbol, F.lit(" work?")).alias("question"), F.lit("where_is").alias("category"))
    )


@dataclass(frozen=True)
class Providers:
    """What can be exchanged for a model."""

    embed: Callable[[Column], Column] = hashed_embedding  # text -> array<float>
    # Texts of one request -> vectors; if given, an ingest sends packed requests and `embed` serves questions only.
    embed_batch: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None
    suppose: Callable[[Column], Column] = _supposed_answer  # question -> hypothetical answer
    answer: Callable[[Column, Column], Column] = _first_block  # question, context -> answer
    judge: Callable[[Column, Column], Column] = _cited_verdict  # question, answer -> JSON verdict
    ask_about: Callable[[Column, Column, Column, Column], Column] = _question_about  # path, kind, symbol, text -> JSON
    rerank: Scorer = overlap_scorer  # question, text -> score
    code_rerank: Scorer = overlap_scorer


OFFLINE = Providers()


def hyde_query(providers: Providers, question: Column) -> Column:
    """What the vector leg embeds: a hypothetical answer, then the question."""
    return F.concat(providers.suppose(question), F.lit("\n\n"), question)


class Refused(Exception):
    """A request the model will never accept; trying again is useless."""


def model_column(
    primary: Callable[..., str],
    backup: Callable[..., str] | None = None,
    attempts: int = 2,
    pause: Callable[[float], None] = time.sleep,
    forgive: bool = False,
) -> Callable[..., Column]:
    """A per-row model call as an Arrow-batched column function.

    The first model is tried `attempts` times with growing pauses, then the
    backup once; a refused request is raised at once.  With `forgive`, as for a
    judge, a row whose call fails is null and the job goes on.
    """

    def call(arguments: Sequence[str]) -> str:
        for attempt in range(attempts):
            try:
                return primary(*arguments)
            except Refused:
                raise
            except Exception:
                if attempt == attempts - 1 and backup is None:
                    raise
                if attempt < attempts - 1:
                    pause(2.0**attempt)
        return backup(*arguments)

    def attempt_row(arguments: Sequence[str]) -> str | None:
        try:
            return call(arguments)
        except Exception:
            if not forgive:
                raise
            return None

    @F.pandas_udf("string")
    def replies(*columns: pd.Series) -> pd.Series:
        return pd.Series([attempt_row(row) for row in zip(*columns)], dtype=object)

    return replies
