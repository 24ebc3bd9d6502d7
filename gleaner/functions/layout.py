"""How hits are written out for a reader or a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.arrays import let

# Fixed values.
PREVIEW_CHARS = 400
BLOCK_RULE = "\n\n---\n\n"
NO_RESULTS = "No results."
ISSUE_PREFIX = "_gh"


def context_block(number: Column, path: Column, start: Column, end: Column, kind: Column, symbol: Column, text: Column) -> Column:
    """One numbered snippet of a prompt."""
    named = F.when(symbol != "", F.concat(F.lit(", "), symbol)).otherwise("")
    return F.format_string("[#%d] %s (lines %d-%d, %s%s)\n%s", number, path, start, end, kind, named, text)


def preview_block(number: Column, path: Column, start: Column, end: Column, kind: Column, symbol: Column, text: Column) -> Column:
    """One numbered line with a short look at the text."""
    named = F.when(symbol != "", F.concat(F.lit(" · "), symbol)).otherwise("")
    look = F.replace(F.substring(text, 1, PREVIEW_CHARS), F.lit("\n"), F.lit(" "))
    return F.format_string("[%d] %s:%d-%d (%s%s)\n    %s", number, path, start, end, kind, named, look)


def quoted(text: Column) -> Column:
    """A string literal as Python writes it."""
    plain = text
    for mark, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(mark), F.lit(code))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def joined(blocks: Column, rule: str) -> Column:
    """array<struct<..., block>> in the order of the other fields as one text."""
    return F.array_join(F.transform(F.array_sort(blocks), lambda b: b["block"]), rule)


def citation(path: Column, start: Column, end: Column, owner: str) -> Column:
    """Link for a tracker item (prefix/repo/kind/number), else path and line span."""
    return let(
        F.split(path, "/"),
        lambda part: F.when(
            F.startswith(path, F.lit(ISSUE_PREFIX + "/")) & (F.size(part) == 4),
            F.concat(
                F.lit(f"https://github.com/{owner}/"),
                F.get(part, F.lit(1)),
                F.when(F.get(part, F.lit(2)) == "pr", "/pull/").otherwise("/issues/"),
                F.get(part, F.lit(3)),
            ),
        ).otherwise(F.format_string("%s:%d-%d", path, start, end)),
    )
