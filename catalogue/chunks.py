"""Ingest queries: chunking, ids, duplicates, tracker items, batches and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import sql, views
from catalogue.texts import big
from gleaner.operators import batching, chunking, items, sampling
from gleaner.sources import files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.corpus(spark, sf_dir, spread=True).select(F.col("chunk_idx").alias("doc_id"), "source_path", "text")


def _doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.document_chunks(_docs(spark, sf_dir))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_chunks(spark, sf_dir).select(
        "doc_id", big("piece").alias("piece"), "chunk_id", big("start_line").alias("start_line"),
        big("end_line").alias("end_line"), F.md5("text").alias("digest"),
    )


def doc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.readable_docs(_docs(spark, sf_dir)).select("doc_id", big(F.length("text")).alias("n_chars"))


def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.pieces(F.col("text"))).alias("piece", "p"))
    return cut.select("doc_id", big("piece").alias("piece"), big("p.n_tokens").alias("n_tokens"), F.md5("p.text").alias("digest"))


def min_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a code unit: short ones go."""
    lines = _docs(spark, sf_dir).select("doc_id", "source_path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    units = lines.select(
        "doc_id", "source_path", "text", F.lit("class_header").alias("kind"), F.lit("Line").alias("symbol"),
        (F.col("line") + 1).alias("start_line"), (F.col("line") + 1).alias("end_line"),
    )
    return chunking.unit_chunks(units).select("doc_id", "chunk_id", F.md5("text").alias("digest"))


def dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chunking.keep_first(_doc_chunks(spark, sf_dir), [F.col("doc_id"), F.col("piece")])
    return kept.select("chunk_id", "doc_id", big("piece").alias("piece"), F.md5("text").alias("digest"))


def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an exact earlier copy go; the digest stands for the text in the shuffle."""
    hashed = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("digest"))
    return chunking.keep_first(hashed, [F.col("doc_id")], "digest")


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module written from every document."""
    docs = views.texts(spark, sf_dir, "documents")
    plain = F.regexp_replace("text", "[^A-Za-z0-9 .,\n]", " ")
    body = F.regexp_replace(plain, "\n", "'\n        x = '")
    source = F.format_string(
        "import os, sys\n\nfrom a import (b,\n    c)\n"
        '"""Notes on item %1$d: one two three four five six seven eight nine ten eleven twelve thirteen fourteen"""\n'
        "import late\n\n@register(x=1)\nclass %2$sDoc(Base, metaclass=Meta):\n"
        '    """What it is for: one two three four five six seven eight nine ten eleven twelve\n    thirteen fourteen"""\n'
        "    size = 3\n\n    @cached\n    def item_%1$d(self):\n        x = '%3$s'\n\n"
        "async def load_%1$d(a, b):\n    y = [a, b, 1, 2]\n    x = '''%4$s'''\n\nif True:\n    def hidden():\n        pass\n",
        "doc_id", F.initcap("lang"), body, plain,
    )
    return docs.select(F.format_string("lib/m_%d.py", "doc_id").alias("source_path"), source.cast("binary").alias("content"))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.unit_chunks(files.code_units(_modules(spark, sf_dir)))
    return chunks.select("chunk_id", big("piece").alias("piece"), "kind", F.md5("text").alias("digest"))


def scan_filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file path for every document, some in skipped folders or of other types."""
    folders = F.array(*[F.lit(f) for f in ("src", "build", "lib/venv", "docs", "builder", ".git/x", "dist2")])
    suffixes = F.array(*[F.lit(s) for s in (".md", ".RST", ".txt", ".py", ".PY", ".rs", ".md.bak", "")])
    n = F.col("doc_id")
    path = F.concat(
        F.lit("/data/"), F.get(folders, (n % 7).cast("int")), F.lit("/"), "source", F.lit("/doc_"),
        n.cast("string"), F.get(suffixes, (n % 8).cast("int")),
    )
    paths = views.table(spark, sf_dir, "documents").select(path.alias("path"))
    return paths.select("path", files.file_role(F.col("path")).alias("role")).where("role IS NOT NULL")


def _raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the JSON of a tracker item."""
    pages = views.texts(spark, sf_dir, "pages")
    n = F.col("page_id")
    title = F.when(n % 10 == 0, F.lit("  ")).when(n % 11 == 0, F.lit(None)).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    body = F.when(n % 9 == 0, F.lit(None)).otherwise(F.repeat("html", 1 + (n % 4).cast("int")))
    fields = F.to_json(
        F.struct(
            n.alias("number"),
            title.alias("title"),
            body.alias("body"),
            F.when(n % 3 == 0, "open").when(n % 3 == 1, "closed").alias("state"),
            F.when(n % 5 > 0, F.transform(F.split(F.regexp_extract("url", "//([^/?#]*)", 1), "[.]"), lambda x: F.struct(x.alias("name")))).alias("labels"),
            F.col("url").alias("html_url"),
            F.date_format(F.timestamp_seconds(F.lit(1704067200) + (n * 7919) % 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        )
    )
    marked = F.concat(F.lit('{"pull_request": null, '), F.substring(fields, 2, 2**31 - 1))
    return pages.select(F.when(n % 2 == 1, marked).otherwise(fields).alias("json"))


def json_item_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.parse_items(_raw_items(spark, sf_dir)).select(
        "number", "is_pr", "title", F.md5("body").alias("body_digest"), "state", F.array_join("labels", "|").alias("labels"), "url", "updated_at"
    )


def item_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = items.item_chunks(items.parse_items(_raw_items(spark, sf_dir)), "site")
    return chunks.select("chunk_id", "kind", "symbol", big("end_line").alias("end_line"), big(F.length("text")).alias("n_chars"), F.md5("text").alias("digest"))


LATEST = 100


def items_latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.latest_closed(items.parse_items(_raw_items(spark, sf_dir)), LATEST).select("number", "updated_at")


def budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = views.texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_idx"), F.size(chunking.whitespace_tokens(F.col("text"))).alias("n_tokens")
    )
    return batching.request_batches(sized).select("flush", big("batch").alias("batch"), "chunk_idx", big("n_tokens").alias("n_tokens"))


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with paths and symbols that the quality rules tell apart."""
    n = F.col("chunk_idx")
    roots = F.array(*[F.lit(r) for r in ("", "tests/", "pkg/tests/", "dev/", "devel-common/", "devices/", "pkg/test_")])
    return views.corpus(spark, sf_dir).select(
        "chunk_idx", "text", F.when(n % 4 == 0, "class_header").otherwise("function").alias("kind"),
        F.concat(F.get(roots, (n % 7).cast("int")), "source_path").alias("source_path"),
        F.when(n % 5 == 0, "<module>").when(n % 9 == 0, "").when(n % 11 == 0, F.lit(None)).otherwise(F.col("symbol")).alias("symbol"),
        F.format_string("c_%d", "chunk_idx").alias("chunk_id"),
    )


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.worth_asking(_varied(spark, sf_dir)).select("chunk_id", "source_path", "symbol")


SAMPLE = 100
SOURCES = 10


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(views.corpus(spark, sf_dir).select("chunk_id"), SAMPLE, "chunk_id")


def question_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.question_sources(_varied(spark, sf_dir), SOURCES).select("chunk_id", "source_path")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _doc_chunks(spark, sf_dir)
    return chunks.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("chunk_id").alias("n_ids"),
        F.count_distinct("source_path").alias("n_paths"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        doc_chunks, doc_filter, split_oversized, min_token_filter, dedup_chunks, dedup_texts, code_chunks,
        scan_filter_paths, json_item_parse, item_to_chunk, items_latest_n, budget_batches, quality_filter,
        hash_sample, question_sources, corpus_stats,
    )
}

_WS = r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+"
_DOCS = "docs AS (SELECT chunk_idx AS doc_id, source_path, text FROM corpus)"


def _toks(source: str, keep: str, text: str = "text") -> str:
    return f"toks AS (SELECT {keep}, regexp_extract_all({text}, '{_WS}') AS t, {text} AS whole FROM {source})"


def _lines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


_WINDOWS = f"""
starts AS (
  SELECT doc_id, source_path, t, s, s // 425 AS piece
  FROM (SELECT *, unnest(range(0, len(t), 425)) AS s FROM toks) WHERE s = 0 OR s + 75 <= len(t)),
wins AS (
  SELECT doc_id, source_path, piece, array_to_string(t[s + 1 : s + 500], '') AS body, array_to_string(t[1 : s], '') AS prefix FROM starts),
chunks AS (
  SELECT doc_id, source_path, piece, body, 1 + {_lines('prefix')} AS start_line, 1 + {_lines('prefix')} + {_lines('body')} AS end_line FROM wins),
ids AS (SELECT *, source_path || ':' || start_line || '-' || end_line || ':doc:_' AS chunk_id FROM chunks)"""

_CHUNKS = sql.ctes(sql.CORPUS, _DOCS, _toks("docs", "doc_id, source_path"), _WINDOWS)

_PIECES = """
cut AS (
  SELECT *, CASE WHEN len(t) <= 1500 THEN [0] ELSE range(0, len(t), 1400) END AS offs FROM toks),
pieces AS (
  SELECT * EXCLUDE (t, whole, offs, s), s // 1400 AS piece,
         CASE WHEN len(t) <= 1500 THEN whole ELSE array_to_string(t[s + 1 : s + 1500], '') END AS body,
         CASE WHEN len(t) <= 1500 THEN len(t) ELSE len(t[s + 1 : s + 1500]) END AS n_tokens
  FROM (SELECT *, unnest(offs) AS s FROM cut))"""

_UNITS = r"""
src AS (
  SELECT doc_id, 'lib/m_' || doc_id || '.py' AS path, upper(lang[1]) || lang[2:] AS lang,
         regexp_replace(text, '[^A-Za-z0-9 .,\n]', ' ', 'g') AS plain FROM documents),
nl AS (SELECT *, length(plain) - length(replace(plain, chr(10), '')) AS n FROM src),
units AS (
  SELECT path, 'module_header' AS kind, '<module>' AS symbol, 1 AS a, 4 AS b,
         'import os, sys' || chr(10) || 'from a import (b,' || chr(10) || '    c)' || chr(10) || 'TRIPLENotes on item ' || doc_id
         || ': one two three four five six seven eight nine ten eleven twelve thirteen fourteenTRIPLE' AS text FROM nl
  UNION ALL
  SELECT path, 'class_header', lang || 'Doc', 8, 16 + n, 'class ' || lang || 'Doc(Base, metaclass=Meta):' || chr(10)
         || '    TRIPLEWhat it is for: one two three four five six seven eight nine ten eleven twelve' || chr(10) || '        thirteen fourteenTRIPLE' FROM nl
  UNION ALL
  SELECT path, 'method', lang || 'Doc.item_' || doc_id, 14, 16 + n, '@cached' || chr(10) || '    def item_' || doc_id || '(self):' || chr(10)
         || '        x = ''' || replace(plain, chr(10), '''' || chr(10) || '        x = ''') || '''' FROM nl
  UNION ALL
  SELECT path, 'function', 'load_' || doc_id, 18 + n, 20 + n + n, 'async def load_' || doc_id || '(a, b):' || chr(10)
         || '    y = [a, b, 1, 2]' || chr(10) || '    x = ''''''' || plain || '''''''' FROM nl)""".replace("TRIPLE", '"' * 3)

_ITEMS = r"""
items AS (
  SELECT page_id AS number, page_id % 2 = 1 AS is_pr,
         CASE WHEN page_id % 10 = 0 THEN '  ' WHEN page_id % 11 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
         CASE WHEN page_id % 9 = 0 THEN '' ELSE repeat(html, 1 + (page_id % 4)::INT) END AS body,
         CASE WHEN page_id % 3 = 0 THEN 'open' ELSE 'closed' END AS state,
         CASE WHEN page_id % 5 > 0 THEN string_split(regexp_extract(url, '//([^/?#]*)', 1), '.') ELSE [] END AS labels, url,
         strftime(make_timestamp((1704067200 + (page_id * 7919) % 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS updated_at
  FROM pages)"""

_VARIED = """
varied AS (
  SELECT 'c_' || chunk_idx AS chunk_id, text, CASE WHEN chunk_idx % 4 = 0 THEN 'class_header' ELSE 'function' END AS kind,
         ['', 'tests/', 'pkg/tests/', 'dev/', 'devel-common/', 'devices/', 'pkg/test_'][chunk_idx % 7 + 1] || source_path AS source_path,
         CASE WHEN chunk_idx % 5 = 0 THEN '<module>' WHEN chunk_idx % 9 = 0 THEN '' WHEN chunk_idx % 11 = 0 THEN NULL ELSE symbol END AS symbol
  FROM corpus),
good AS (
  SELECT * FROM varied
  WHERE length(text) >= 200 AND symbol IS NOT NULL AND symbol NOT IN ('', '<module>') AND kind <> 'class_header'
    AND NOT contains(source_path, '/tests/') AND NOT contains(source_path, '/test_')
    AND NOT starts_with(source_path, 'tests/') AND NOT starts_with(source_path, 'dev/') AND NOT starts_with(source_path, 'devel-common/'))"""

ORACLES = {
    "doc_chunks": f"{_CHUNKS} SELECT doc_id, piece, chunk_id, start_line, end_line, md5(body) AS digest FROM ids",
    "doc_filter": r"SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50",
    "split_oversized": f"""{sql.ctes(_toks("documents", "doc_id"), _PIECES)}
SELECT doc_id, piece, n_tokens, md5(body) AS digest FROM pieces""",
    "min_token_filter": f"""
WITH l AS (SELECT doc_id, source_path, string_split(text, chr(10)) AS parts FROM corpus_docs),
e AS (SELECT doc_id, source_path, unnest(parts) AS text, generate_subscripts(parts, 1) AS line FROM l)
SELECT doc_id, source_path || ':' || line || '-' || line || ':class_header:Line' AS chunk_id, md5(text) AS digest
FROM e WHERE len(regexp_extract_all(text, '{_WS}')) >= 20""".replace("WITH l", f"{sql.ctes(sql.CORPUS, _DOCS)},\nl").replace("corpus_docs", "docs"),
    "dedup_chunks": f"""{_CHUNKS}
SELECT chunk_id, doc_id, piece, md5(body) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, piece) AS rn FROM ids) WHERE rn = 1""",
    "dedup_texts": "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "code_chunks": f"""{sql.ctes(_UNITS, _toks("units", "path, kind, symbol, a, b"))},
cut AS (SELECT *, CASE WHEN kind IN ('class_header', 'module_header') OR len(t) <= 1500 THEN [0] ELSE range(0, len(t), 1400) END AS offs FROM toks),
pieces AS (
  SELECT path, kind, symbol, a, b, s // 1400 AS piece,
         CASE WHEN len(offs) = 1 THEN whole ELSE array_to_string(t[s + 1 : s + 1500], '') END AS body,
         CASE WHEN len(offs) = 1 THEN len(t) ELSE len(t[s + 1 : s + 1500]) END AS n_tokens
  FROM (SELECT *, unnest(offs) AS s FROM cut))
SELECT path || ':' || a || '-' || b || ':' || kind || ':' || symbol AS chunk_id, piece, kind, md5(body) AS digest FROM pieces WHERE n_tokens >= 20""",
    "scan_filter_paths": """
WITH p AS (
  SELECT doc_id AS n, ['src', 'build', 'lib/venv', 'docs', 'builder', '.git/x', 'dist2'][doc_id % 7 + 1] AS folder,
         ['.md', '.RST', '.txt', '.py', '.PY', '.rs', '.md.bak', ''][doc_id % 8 + 1] AS suffix, source FROM documents)
SELECT '/data/' || folder || '/' || source || '/doc_' || n || suffix AS path, CASE WHEN suffix = '.py' THEN 'code' ELSE 'doc' END AS role
FROM p WHERE folder NOT IN ('build', 'lib/venv', '.git/x') AND suffix IN ('.md', '.RST', '.txt', '.py')""",
    "json_item_parse": f"""{sql.ctes(_ITEMS)}
SELECT number, is_pr, title, md5(body) AS body_digest, state, array_to_string(labels, '|') AS labels, url, updated_at FROM items""",
    "item_to_chunk": rf"""{sql.ctes(_ITEMS)},
named AS (
  SELECT *, regexp_replace(title, '^\s+|\s+$', '', 'g') AS name, regexp_replace(body, '^\s+|\s+$', '', 'g') AS b,
         CASE WHEN is_pr THEN 'pr' ELSE 'issue' END AS kind FROM items),
txt AS (
  SELECT *, '# ' || name || chr(10) || chr(10) || '#' || number || ' · ' || upper(kind) || ' · state: ' || state || ' · labels: '
         || CASE WHEN len(labels) = 0 THEN 'none' ELSE array_to_string(labels, ', ') END
         || CASE WHEN b = '' THEN '' ELSE chr(10) || chr(10) || CASE WHEN length(b) > 6000
              THEN substr(b, 1, 6000) || chr(10) || chr(10) || '[... truncated ...]' ELSE b END END AS text
  FROM named WHERE name <> '')
SELECT '_gh/site/' || CASE WHEN is_pr THEN 'pr' ELSE 'issues' END || '/' || number || ':1-' || (1 + {_lines('text')}) || ':' || kind || ':' || substr(name, 1, 80) AS chunk_id,
       kind, substr(name, 1, 80) AS symbol, 1 + {_lines('text')} AS end_line, length(text) AS n_chars, md5(text) AS digest FROM txt""",
    "items_latest_n": f"{sql.ctes(_ITEMS)} SELECT number, updated_at FROM items WHERE state = 'closed' ORDER BY updated_at DESC, number DESC LIMIT {LATEST}",
    "budget_batches": f"""
WITH RECURSIVE sized AS (
  SELECT doc_id // 256 AS flush, doc_id % 256 AS pos, doc_id, len(regexp_extract_all(text, '{_WS}')) AS n FROM documents),
packed AS (
  SELECT flush, pos, doc_id, n, 0 AS batch, n AS used FROM sized WHERE pos = 0
  UNION ALL
  SELECT s.flush, s.pos, s.doc_id, s.n, CASE WHEN p.used + s.n > 20000 THEN p.batch + 1 ELSE p.batch END,
         CASE WHEN p.used + s.n > 20000 THEN s.n ELSE p.used + s.n END
  FROM packed p JOIN sized s ON s.flush = p.flush AND s.pos = p.pos + 1)
SELECT flush, batch::BIGINT AS batch, doc_id AS chunk_idx, n AS n_tokens FROM packed""",
    "quality_filter": f"{sql.ctes(sql.CORPUS, _VARIED)} SELECT chunk_id, source_path, symbol FROM good",
    "hash_sample": f"{sql.ctes(sql.CORPUS)} SELECT chunk_id FROM corpus ORDER BY md5('42:' || chunk_id), chunk_id LIMIT {SAMPLE}",
    "question_sources": f"""{sql.ctes(sql.CORPUS, _VARIED)}
SELECT chunk_id, source_path FROM good ORDER BY md5('42:' || chunk_id), chunk_id LIMIT {SOURCES}""",
    "corpus_stats": f"""{_CHUNKS}
SELECT 'doc' AS kind, count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_ids, count(DISTINCT source_path) AS n_paths, sum(length(body))::BIGINT AS n_chars FROM ids""",
}
