"""A source tree as tables: which files count, documents, and Python code units."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.arrays import let
from gleaner.functions.text import MODULE_SYMBOL
from gleaner.operators.chunking import document_chunks, readable_docs, unit_chunks
from gleaner.operators.joins import stack
from gleaner.sources.tree import list_files, read_files

# Fixed values.
SKIP_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build")
DOC_EXTENSIONS = (".md", ".rst", ".txt")
CODE_EXTENSION = ".py"
UNIT_SCHEMA = "source_path string, ord int, kind string, symbol string, text string, start_line int, end_line int"


def file_role(path: Column) -> Column:
    """doc, code or null, judged by the absolute path."""

    def role(parts: Column) -> Column:
        name = F.element_at(parts, -1)
        # A leading dot alone is part of the name, as in ".md".
        suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
        wanted = F.when(F.lower(suffix).isin(*DOC_EXTENSIONS), "doc").when(suffix == CODE_EXTENSION, "code")
        return F.when(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIP_DIRS])), wanted)

    return let(F.split(path, "/"), role)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(source_path relative to root, role, content) of the files that count; others are not opened, nor are skipped folders."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    if set(base.split("/")) & set(SKIP_DIRS):
        return spark.createDataFrame([], "source_path string, role string, content binary")
    listed = list_files(spark, base, SKIP_DIRS).withColumn("role", file_role(F.col("path"))).where("role IS NOT NULL")
    return read_files(spark, base, listed).select(F.col("path").alias("source_path"), "role", "content")


def document_texts(files: DataFrame) -> DataFrame:
    """Documents as text; a file that is not UTF-8 gives no row."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.where("role = 'doc'").select(
        "source_path", F.regexp_replace(text, "\r\n?", "\n").alias("text")
    ).where("text IS NOT NULL")


def _text_of(node: ast.AST, lines: list[bytes]) -> str:
    """Source of a node from its first decorator on."""
    first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
    cut = lines[first - 1 : node.end_lineno]
    cut[-1] = cut[-1][: node.end_col_offset]
    cut[0] = cut[0][node.col_offset :]
    return b"".join(cut).decode("utf-8", errors="replace")


def _is_string(node: ast.AST) -> bool:
    if not isinstance(node, ast.Expr):
        return False
    value = node.value
    return isinstance(value, ast.JoinedStr) or (isinstance(value, ast.Constant) and isinstance(value.value, (str, bytes)))


def _bases(source: str) -> str:
    """The bracketed base list of a class statement, as written."""
    depth, start, written = 0, None, source.splitlines(keepends=True)
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        if token.string in "([{" and token.type == tokenize.OP:
            if depth == 0 and token.string == "(":
                start = token.start
            depth += 1
        elif token.string in ")]}" and token.type == tokenize.OP:
            depth -= 1
            if depth == 0 and start is not None:
                (row, col), (end_row, end_col) = start, token.end
                span = written[row - 1 : end_row]
                span[-1] = span[-1][:end_col]
                span[0] = span[0][col:]
                return "".join(span)
        elif token.string == ":" and depth == 0:
            break
    return ""


def _units(source: bytes) -> Iterator[tuple[str, str | None, str, int, int]]:
    """(kind, symbol, text, first line, last line) of one Python file."""
    lines = source.splitlines(keepends=True)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    tree = ast.parse(source)

    def span(node: ast.AST) -> tuple[int, int]:
        return min([node.lineno, *[d.lineno for d in node.decorator_list]]), node.end_lineno

    head: list[str] = []
    for node in tree.body:
        if isinstance(node, (*functions, ast.ClassDef)):
            break
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            head.append(_text_of(node, lines))
        elif _is_string(node):
            # A string ends the header: imports behind a docstring are not part of it.
            head.append(_text_of(node, lines))
            break
    header = "\n".join(head).strip()
    if header:
        yield "module_header", MODULE_SYMBOL, header, 1, header.count("\n") + 1

    for node in tree.body:
        if isinstance(node, functions):
            yield "function", node.name, _text_of(node, lines), *span(node)
        elif isinstance(node, ast.ClassDef):
            plain = b"".join(lines[node.lineno - 1 : node.end_lineno]).decode("utf-8", errors="replace")
            said = [_text_of(s, lines) for s in node.body if _is_string(s)]
            text = "\n".join(
                [f"class {node.name}{_bases(plain)}:", *["    " + s.replace("\n", "\n    ") for s in said]]
            )
            yield "class_header", node.name, text, *span(node)
            for member in node.body:
                if isinstance(member, functions):
                    yield "method", f"{node.name}.{member.name}", _text_of(member, lines), *span(member)


def code_units(files: DataFrame) -> DataFrame:
    """files(source_path, content) -> one row per module header, class header, function and method.

    A file that does not parse comes back whole, with kind `unparsed`.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [field.split()[0] for field in UNIT_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["source_path"], batch["content"]):
                content = bytes(content)
                if not content.strip():
                    continue
                try:
                    found = list(_units(content))
                except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
                    found = [("unparsed", None, content.decode("utf-8", errors="replace"), 1, 1)]
                rows += [(path, i, *unit) for i, unit in enumerate(found)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("source_path", "content").mapInPandas(parse, UNIT_SCHEMA)


def tree_chunks(files: DataFrame, keep_pieces: bool = False) -> DataFrame:
    """All chunks of a tree, with (source_path, ord, piece) as their order."""
    units = code_units(files.where("role = 'code'"))
    code = unit_chunks(units.where("kind <> 'unparsed'"), keep_pieces)
    unparsed = units.where("kind = 'unparsed'").select("source_path", "ord", "text")
    docs = readable_docs(document_texts(files)).withColumn("ord", F.lit(0))
    return stack(code, document_chunks(unparsed), document_chunks(docs))
