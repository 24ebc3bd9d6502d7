"""Tracker items (issues and pull requests) as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.arrays import let
from gleaner.functions.layout import ISSUE_PREFIX
from gleaner.operators.chunking import newlines, with_chunk_id

# Fixed values.
BODY_CHARS = 6000
BODY_CUT_MARK = "\n\n[... truncated ...]"
TITLE_CHARS = 80

ITEM_JSON = (
    "number bigint, title string, body string, state string, labels array<struct<name string>>, "
    "html_url string, closed_at string, updated_at string"
)


def parse_items(raw: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row -> number, is_pr, title, body, state, labels, url, closed_at, updated_at.

    An item is a pull request when the key is there, whatever its value.
    """
    item = F.from_json(F.col(column), ITEM_JSON)
    is_pr = F.array_contains(F.json_object_keys(column), "pull_request")
    state = F.when(F.col("i.state") != "", F.col("i.state"))
    return raw.select(item.alias("i"), is_pr.alias("is_pr")).select(
        "i.number",
        "is_pr",
        F.coalesce("i.title", F.lit("")).alias("title"),
        F.coalesce("i.body", F.lit("")).alias("body"),
        F.coalesce(state, F.lit("closed")).alias("state"),
        F.coalesce(F.transform("i.labels", lambda x: x["name"]), F.array().cast("array<string>")).alias("labels"),
        F.coalesce("i.html_url", F.lit("")).alias("url"),
        "i.closed_at",
        "i.updated_at",
    )


def latest_closed(items: DataFrame, n: int | None = None) -> DataFrame:
    """The closed items: all, or the n updated last."""
    closed = items.where("state = 'closed'")
    return closed if n is None else closed.orderBy(F.desc("updated_at"), F.desc("number")).limit(n)


def item_chunks(items: DataFrame, repo: str, body_chars: int | None = BODY_CHARS) -> DataFrame:
    """Items with a title -> chunks of kind issue or pr; None keeps whole bodies."""
    title = tx.strip(F.col("title"))
    body: Column = let(
        tx.strip(F.coalesce("body", F.lit(""))),
        lambda b: F.when(
            F.lit(body_chars is not None) & (F.length(b) > (body_chars or 0)),
            F.concat(F.substring(b, 1, body_chars or 0), F.lit(BODY_CUT_MARK)),
        ).when(b != "", b),
    )
    kind = F.when(F.col("is_pr"), "pr").otherwise("issue")
    labels = F.when(F.size("labels") > 0, F.array_join("labels", ", ")).otherwise("none")
    facts = F.format_string("#%d · %s · state: %s · labels: %s", "number", F.upper(kind), "state", labels)
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), title), facts, body)
    segment = F.when(F.col("is_pr"), "pr").otherwise("issues")
    chunks = items.where(title != "").select(
        text.alias("text"),
        F.format_string(f"{ISSUE_PREFIX}/{repo}/%s/%d", segment, "number").alias("source_path"),
        kind.alias("kind"),
        F.substring(title, 1, TITLE_CHARS).alias("symbol"),
        F.lit(1).alias("start_line"),
    )
    return with_chunk_id(chunks.withColumn("end_line", newlines(F.col("text")) + 1))
