"""Reading what a model wrote back: verdicts, generated questions, refusals, tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.arrays import let
from gleaner.functions.text import SPACE_CLASS, strip

# Fixed values.
INSUFFICIENT = "<INSUFFICIENT_CONTEXT>"
CATEGORIES = ("factual", "where_is", "conceptual", "multi_hop")
REASON_CHARS = 300
SEARCH_K = 5

_SPACE = f"[{SPACE_CLASS}]*"


def unfenced(reply: Column) -> Column:
    """The reply without the code fences around it."""
    return F.regexp_replace(strip(reply), f"(?md)^```(?:json)?{_SPACE}|{_SPACE}```$", "")


def _field(document: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(document, path, as_type)


def _is_object(document: Column) -> Column:
    return F.schema_of_variant(document).startswith("OBJECT")


def parse_verdict(reply: Column) -> Column:
    """struct<score int, reason string>, score held within 0..3.

    A JSON object with a numeric score wins; whole numbers written as text and
    fractions count as their integer part.  Anything else is searched for a
    digit after "score", and the reply itself becomes the reason.
    """

    def read(text: Column, document: Column) -> Column:
        score = _field(document, "$.score")
        kind = F.schema_of_variant(score)
        shown = _field(document, "$.score", "string")
        number = (
            F.when(kind == "BOOLEAN", F.when(shown == "true", 1.0).otherwise(0.0))
            .when(kind == "STRING", F.when(shown.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(shown).try_cast("double")))
            .when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), shown.try_cast("double"))
        )
        found = F.regexp_extract(text, r'"score"\s*:\s*([0-3])', 1)
        given = _field(document, "$.reason")
        reason = F.when(given.isNull(), "").when(
            F.schema_of_variant(given) == "VOID", "None"
        ).otherwise(_field(document, "$.reason", "string"))
        read_ok = _is_object(document) & number.isNotNull()
        value = F.when(read_ok, number).when(found != "", found.try_cast("double")).otherwise(0.0)
        return F.struct(
            F.greatest(F.lit(0.0), F.least(F.lit(3.0), value)).cast("int").alias("score"),
            F.substring(F.when(read_ok, reason).otherwise(text), 1, REASON_CHARS).alias("reason"),
        )

    return let(unfenced(reply), lambda text: read(text, F.try_parse_json(text)))


def parse_question(reply: Column) -> Column:
    """struct<question, category>, or null where the reply is no usable question."""

    def read(document: Column) -> Column:
        skip, category = _field(document, "$.skip"), _field(document, "$.category", "string")
        skip_text = F.coalesce(_field(document, "$.skip", "string"), F.lit(""))
        skip_kind = F.schema_of_variant(skip)
        # What Python counts as true: anything but null, false, zero and empty.
        skipped = skip.isNotNull() & ~(
            skip_kind.isin("VOID")
            | ((skip_kind == "BOOLEAN") & (skip_text == "false"))
            | (skip_kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & (skip_text.try_cast("double") == 0))
            | ((skip_kind == "STRING") & (skip_text == ""))
            | F.coalesce(skip_text.isin("[]", "{}"), F.lit(False))
        )
        usable = (
            _is_object(document)
            & ~skipped
            & _field(document, "$.question").isNotNull()
            & category.isin(*CATEGORIES)
        )
        return F.when(
            usable,
            F.struct(_field(document, "$.question", "string").alias("question"), category.alias("category")),
        )

    return read(F.try_parse_json(unfenced(reply)))


def is_insufficient(answer: Column) -> Column:
    """The answer starts with the sentinel, blanks and quotes aside."""
    return F.startswith(F.regexp_replace(strip(answer), "^[`'\"]+", ""), F.lit(INSUFFICIENT))


def search_arguments(arguments: Column, default_k: int = SEARCH_K) -> Column:
    """struct<query, k> of a search call given as JSON; k is not clamped."""
    document = F.try_parse_json(arguments)
    return F.struct(
        F.coalesce(strip(_field(document, "$.query", "string")), F.lit("")).alias("query"),
        F.coalesce(_field(document, "$.k", "string").try_cast("double").cast("int"), F.lit(default_k)).alias("k"),
    )
