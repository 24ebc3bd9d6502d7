"""Texts made to break hashes and to be slow."""

import random
import time

from pyspark.sql import functions as F

from gleaner.llm import secrets, substrings


def test_patterns_that_share_a_polynomial_are_different_words(spark):
    pattern = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = pattern.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{pattern} {tail}"), (2, f"{other} {tail}"), (3, f"{other} {tail}")], "doc_id bigint, text string")
    spans = {r["id"]: [tuple(s) for s in r["spans"]] for r in substrings.removal(docs).collect()}
    assert spans == {1: [], 2: [], 3: [(0, 50)]}


def redacted(text, spans, placeholder=secrets.PLACEHOLDER):
    out, upto = [], 0
    for i, (start, end) in enumerate(spans):
        if i == 0 or start > upto:
            out += [text[upto:start], placeholder]
        upto = max(upto, end)
    return "".join(out) + text[upto:]


SPAN = "array<struct<start:int,kind:int,end:int>>"


def test_redaction_of_many_spans_in_long_texts(spark):
    rng = random.Random(2)
    rows = []
    for n, count in ((0, 0), (5, 1), (1024, 3), (2048, 2), (5000, 40), (9000, 700)):
        text = "".join(rng.choice("abé\U0001f600 \n") for _ in range(n))
        starts = sorted(rng.randrange(n) for _ in range(count))
        spans = [(s, 0, min(n, s + rng.randrange(1, 30))) for s in starts]
        rows.append((text, spans))
    rows += [("x" * 1024, [(0, 0, 1024)]), ("y" * 3000, [(1023, 0, 1025), (2048, 0, 3000)])]
    df = spark.createDataFrame(rows, f"text string, spans {SPAN}")
    got = [r[0] for r in df.select(secrets.redact(F.col("text"), F.col("spans"))).collect()]
    assert sorted(got) == sorted(redacted(text, [(s, e) for s, _, e in spans]) for text, spans in rows)


def test_redaction_time_grows_with_the_text(spark):
    df = spark.range(1).select(
        F.repeat(F.lit("secret text "), 100_000).alias("text"),
        F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((i * 12).alias("start"), F.lit(0).alias("kind"), (i * 12 + 6).alias("end"))).alias("spans"),
    )
    start = time.time()
    [[length]] = df.select(F.length(secrets.redact(F.col("text"), F.col("spans")))).collect()
    assert length == 100_000 * (len(secrets.PLACEHOLDER) + 6) and time.time() - start < 60
