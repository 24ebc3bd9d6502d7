"""Quality rules as a bitmask ledger.

Every rule is evaluated once.  The ledger keeps one row per document with the
measurements and a bit per failed rule; policies are versioned masks over it,
so a new policy, or the effect of leaving a rule out, needs no second look at
a text.

A null text counts as empty (no words: it fails `few_words`).  Ids are carried
along unread, so null and repeated ids are kept row by row.  Empty tables give
empty ledgers.  Other columns are not read; `ledger` returns the id and its own
columns, `kept` all columns of its input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, let, whole, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

#: Name and failing condition; the place in the list is the bit.  Append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
)
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """Documents that fail any rule of the mask go."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_words")),
    "v1": Policy("v1", tuple(BIT)),
}


def _repeat_words(tokens: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Windows are compared by a 64-bit hash within their text.  Only where one
    repeats are they sorted, and each looked at next to its neighbours.
    """

    def windows() -> Column:
        starts = F.slice(tokens, F.lit(1), F.size(tokens) - WINDOW + 1)
        return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(tokens, i + j) for j in range(1, WINDOW)]))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def twice(ordered: Column) -> Column:
        def twin(window: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(ordered, j)["hash"] == window["hash"], F.lit(False))
            return F.when(same(i - 1) | same(i + 1), window["at"])

        places = F.filter(F.transform(ordered, twin), lambda at: at.isNotNull())
        return let(F.array_sort(places), covered)

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.array_sort(placed), twice)
        ).otherwise(0)

    return F.when(F.size(tokens) <= WINDOW, 0).otherwise(let(windows(), counted)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, the measurements, and `failed`, a bit per failed rule."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    # One expression over the split text: the words are never written to a row.
    counts = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    line_counts = let(
        lines,
        lambda each: F.struct(
            F.size(each).cast("long").alias("n_lines"),
            (F.size(each) - F.size(F.array_distinct(each))).cast("long").alias("n_dup_lines"),
        ),
    )
    measured = (
        docs.select(id_col, *keep, whole(text_col).alias("__text"))
        .select(
            id_col,
            *keep,
            counts.alias("__w"),
            line_counts.alias("__l"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        )
        .select(id_col, *keep, "__w.*", "__l.*", "n_symbols", "n_upper")
    )
    failed = F.lit(0)
    for name, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), BIT[name]).otherwise(0))
    return measured.withColumn("failed", failed)


def verdict(policy: Policy) -> Column:
    """True for the documents that a policy keeps, over a ledger."""
    return F.col("failed").bitwiseAND(policy.mask) == 0


def kept(docs: DataFrame, policy: Policy = POLICIES["v1"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body"), row.alias("__row"))
    return ledger(packed, "__id", "__body", ("__row",)).where(verdict(policy)).select("__row.*")


def ablations(rows: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger is first counted by its failure bits, at most 2 ** rules rows.
    """
    counted = rows.groupBy(F.col("failed").bitwiseAND(policy.mask).alias("bits")).agg(F.count("*").alias("docs"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in policy.rules]))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    count = lambda condition: F.sum(F.when(condition, F.col("docs")).otherwise(0))
    return (
        counted.select("bits", "docs", each.alias("r"))
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
            count(F.col("bits") == F.col("r.bit")).alias("failed_alone"),
            count(rest == 0).alias("kept_without"),
        )
    )
