"""Documents and long code units cut into windows of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.arrays import let, positions
from gleaner.operators.joins import top_ranked

# Fixed values.
WINDOW_TOKENS = 500
WINDOW_OVERLAP = 75
MAX_UNIT_TOKENS = 1500
UNIT_OVERLAP = 100
MIN_UNIT_TOKENS = 20
MIN_DOC_CHARS = 50

# A tokenizer turns text into pieces that concatenate back to it.
Tokenizer = Callable[[Column], Column]


def whitespace_tokens(text: Column) -> Column:
    """Words with the blanks before them; a blank tail is a token of its own."""
    return F.regexp_extract_all(text, F.lit(r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+"), F.lit(0))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _running_total(counts: Column) -> Column:
    """[a, b, c] -> [0, a, a+b]: what comes before each element."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(
        counts,
        start,
        lambda acc, n: F.struct(
            (acc["sum"] + n).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")
        ),
    )["before"]


def windows(text: Column, base_line: Column, tokenizer: Tokenizer = whitespace_tokens) -> Column:
    """array<struct<text, start_line, end_line>>: 500 tokens, 75 shared with the next.

    The last window is the first that is not full, so a text of exactly 500
    tokens gets a second window of 75.
    """
    step = WINDOW_TOKENS - WINDOW_OVERLAP

    def cut(toks: Column) -> Column:
        n = F.size(toks)
        last = F.when(n < WINDOW_TOKENS, 0).otherwise(F.floor((n - WINDOW_TOKENS) / step).cast("int") + 1)
        numbers = F.when(n > 0, positions(0, last)).otherwise(F.array().cast("array<int>"))
        lines = _running_total(
            F.transform(numbers, lambda i: newlines(F.array_join(F.slice(toks, i * step + 1, step), "")))
        )
        return let(
            lines,
            lambda before: F.transform(
                numbers,
                lambda i: let(
                    F.array_join(F.slice(toks, i * step + 1, WINDOW_TOKENS), ""),
                    lambda piece: F.struct(
                        piece.alias("text"),
                        (base_line + F.get(before, i)).cast("int").alias("start_line"),
                        (base_line + F.get(before, i) + newlines(piece)).cast("int").alias("end_line"),
                    ),
                ),
            ),
        )

    return let(tokenizer(text), cut)


def pieces(text: Column, tokenizer: Tokenizer = whitespace_tokens) -> Column:
    """array<struct<text, n_tokens>>: whole up to 1500 tokens, else windows 1400 apart.

    There is no early stop: the last window may lie inside the one before.
    """
    step = MAX_UNIT_TOKENS - UNIT_OVERLAP

    def cut(toks: Column) -> Column:
        n = F.size(toks)
        whole = F.array(F.struct(text.alias("text"), n.alias("n_tokens")))
        count = F.ceil(n / step).cast("int")
        return F.when(n <= MAX_UNIT_TOKENS, whole).otherwise(
            F.transform(
                positions(0, count - 1),
                lambda i: let(
                    F.slice(toks, i * step + 1, MAX_UNIT_TOKENS),
                    lambda w: F.struct(F.array_join(w, "").alias("text"), F.size(w).alias("n_tokens")),
                ),
            )
        )

    return let(tokenizer(text), cut)


def readable_docs(docs: DataFrame) -> DataFrame:
    """Drop documents with fewer than 50 characters between their outer blanks."""
    return docs.where(F.length(tx.strip(F.col("text"))) >= MIN_DOC_CHARS)


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn(
        "chunk_id",
        tx.chunk_id(F.col("source_path"), F.col("start_line"), F.col("end_line"), F.col("kind"), F.col("symbol")),
    )


def document_chunks(docs: DataFrame, tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """docs(source_path, text, ...) -> one row per window; other columns are kept."""
    keep = [c for c in docs.columns if c != "text"]
    cut = docs.select(*keep, F.posexplode(windows(F.col("text"), F.lit(1), tokenizer)).alias("piece", "w"))
    return with_chunk_id(
        cut.select(
            *keep,
            "piece",
            "w.text",
            F.lit("doc").alias("kind"),
            F.lit(None).cast("string").alias("symbol"),
            "w.start_line",
            "w.end_line",
        )
    )


def unit_chunks(units: DataFrame, keep_pieces: bool = False, tokenizer: Tokenizer = whitespace_tokens) -> DataFrame:
    """Code units -> chunks: long functions and methods are split, small parts dropped.

    Pieces of one unit share their id, so a later keep-first step leaves only
    the first; `keep_pieces` numbers the ids instead.
    """
    keep = [c for c in units.columns if c != "text"]
    splits = F.col("kind").isin("function", "method")
    whole = F.array(F.struct(F.col("text").alias("text"), F.size(tokenizer(F.col("text"))).alias("n_tokens")))
    parts = F.when(splits, pieces(F.col("text"), tokenizer)).otherwise(whole)
    cut = (
        units.select(*keep, F.posexplode(parts).alias("piece", "p"))
        .where(F.col("p.n_tokens") >= MIN_UNIT_TOKENS)
        .select(*keep, "piece", "p.text")
    )
    chunks = with_chunk_id(cut)
    if keep_pieces:
        numbered = F.concat("chunk_id", F.lit(":p"), F.col("piece").cast("string"))
        chunks = chunks.withColumn("chunk_id", F.when(F.col("piece") > 0, numbered).otherwise(F.col("chunk_id")))
    return chunks


def keep_first(chunks: DataFrame, order: list[Column], key: str = "chunk_id") -> DataFrame:
    """One row per id, the first in arrival order.

    Each map task first cuts its rows to one per id, so an id repeated in a
    third of all rows sends one row per task.
    """
    return top_ranked(chunks, [key], order, 1, rank="_first").drop("_first")
