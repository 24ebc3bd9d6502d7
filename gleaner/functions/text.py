"""Tokens, identifiers and the text that the keyword index sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.arrays import let

# They decide what the index and the queries match.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been",
    "to", "of", "in", "on", "for", "with", "by", "from", "as", "at", "this", "that",
    "it", "its", "if", "not", "no", "do", "does", "did", "has", "have", "had",
    "self", "cls", "none", "true", "false", "return", "def", "class",
)
WORD = "[A-Za-z0-9]+"
CAMEL_PART = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
IDENTIFIER = (
    r"\b("
    r"[A-Z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"
    r"|[A-Z][a-z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+"
    r"|[a-z_][a-z0-9_]*_[a-z0-9_]+"
    r")\b"
)
MODULE_SYMBOL = "<module>"
IDENTIFIER_REPEATS = 5
SYMBOL_REPEATS = 3

# A word falls apart into several camel parts exactly where one of these
# neighbours meet; testing for that first keeps the part regex off plain words.
CAMEL_SEAM = "[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]|[A-Z][A-Z][a-z]"
# What Python's str.strip() removes.
SPACE_CLASS = (
    "\\t-\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace (trim() knows only the blank)."""
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\\z", "")


def camel_parts(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(CAMEL_PART), F.lit(0))


def _is_token(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(*STOP_WORDS)


def tokens(text: Column) -> Column:
    """Lower-case words, each followed by its camel-case parts; duplicates stay."""

    def word_and_parts(word: Column) -> Column:
        whole = F.array(F.lower(word))
        return F.when(
            word.rlike(CAMEL_SEAM),
            F.concat(whole, F.transform(camel_parts(word), F.lower)),
        ).otherwise(whole)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.filter(F.flatten(F.transform(words, word_and_parts)), _is_token)


def identifiers(question: Column) -> Column:
    """Dotted, CamelCase and snake_case names in order of appearance."""
    return F.regexp_extract_all(question, F.lit("(?U)" + IDENTIFIER), F.lit(1))


def boosted_question(question: Column) -> Column:
    """The question followed by its identifiers, all of them five times over."""
    return let(
        identifiers(question),
        lambda names: F.concat(
            question,
            F.lit(" "),
            F.array_join(F.flatten(F.array_repeat(names, IDENTIFIER_REPEATS)), " "),
        ),
    )


def index_text(text: Column, source_path: Column, symbol: Column) -> Column:
    """Chunk text with its path and its symbol (three times) in front."""
    path = F.when(source_path != "", source_path)
    name = F.when(symbol != "", symbol)
    front = F.concat_ws(" ", path, *[name] * SYMBOL_REPEATS)
    return F.when(front == "", text).otherwise(F.concat(front, F.lit("\n\n"), text))


def symbol_keys(symbol: Column) -> Column:
    """Lower-case names a chunk answers to: the symbol and its last dotted part."""
    name = strip(F.coalesce(symbol, F.lit("")))
    keys = let(
        F.lower(name),
        lambda low: F.array_distinct(
            F.array(low, F.element_at(F.split(low, "[.]"), -1))
        ),
    )
    return F.when((name == "") | (name == MODULE_SYMBOL), F.array().cast("array<string>")).otherwise(keys)


def chunk_id(source_path: Column, start: Column, end: Column, kind: Column, symbol: Column) -> Column:
    shown = F.coalesce(F.when(symbol != "", symbol), F.lit("_"))
    return F.format_string("%s:%d-%d:%s:%s", source_path, start, end, kind, shown)
