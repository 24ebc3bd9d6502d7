"""Question type by wording, and the retrieval method each type gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import identifiers

# Wordings of each question type, tested without regard to case.
MULTI_HOP_PATTERNS = (
    r"\bin\s+what\s+order\b",
    r"\bfull\s+path\s+from\b",
    r"\bend[-\s]?to[-\s]?end\b",
    r"\binteract(?:ion|s)?\s+(?:between|with)\b",
    r"\brespect(?:s)?\s+both\b",
    r"\blifecycle\s+of\b",
    r"\bstep[\s-]by[\s-]step\b",
    r"\bwhich\s+\w+\s+(?:fire|fires|run|runs)\s+and\b",
    r"\bflow\s+(?:from|of)\b",
    r"\bchain\s+of\b",
)
CODE_PATTERNS = (
    r"\bwhere\s+is\b.*\b(?:defined|implemented|located)\b",
    r"\bhow\s+(?:does|do)\s+\w+\.\w+",
    r"\bimplementation\s+of\b",
    r"\bsource\s+code\b",
)
CONCEPTUAL_PATTERNS = (
    r"\bdifference between\b",
    r"\bcompare\b.*\band\b",
    r"\bvs\.?\b",
    r"^\s*what\s+(?:is|are)\s+(?:a\s+|an\s+|the\s+)?",
    r"^\s*what'?s\s+(?:a\s+|an\s+|the\s+)?",
    r"\bwhen\s+should\s+(?:i|you|we)\b",
    r"\bwhy\s+(?:does|do|is|are)\b",
    r"\bexplain\s+(?:the|how)\b",
)
METHOD_OF_TYPE = {"multi_hop": "agentic", "conceptual": "hybrid_hyde", "code": "hybrid"}

# Ignore case, Unicode classes, and a dot that stops at \n only.
_FLAGS = "(?iuUd)"


def _says(question: Column, patterns: tuple[str, ...]) -> Column:
    return question.rlike(_FLAGS + "|".join(f"(?:{p})" for p in patterns))


def classify(question: Column) -> Column:
    """multi_hop, code or conceptual; the first matching rule wins."""
    names_member = F.exists(identifiers(question), lambda name: F.contains(name, F.lit(".")))
    return (
        F.when(_says(question, MULTI_HOP_PATTERNS), "multi_hop")
        .when(names_member, "code")
        .when(_says(question, CODE_PATTERNS), "code")
        .when(_says(question, CONCEPTUAL_PATTERNS), "conceptual")
        .otherwise("code")
    )


def method_for(question_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in METHOD_OF_TYPE.items() for x in pair])
    return table[question_type]
