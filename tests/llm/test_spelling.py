"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from gleaner.llm import queries, spelling


def vocabulary(docs, loss=97, length=5, count=3):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % loss == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def variants(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    want = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        want.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return want


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def listed(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, sf_dir, plain):
    assert listed(queries.op13_spelling_variants(spark, sf_dir)) == variants(vocabulary(plain))


def test_empty_tables(spark, empty):
    assert queries.op13_spelling_variants(spark, empty).collect() == []


def texts():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    docs = []
    for i in range(120):
        said = []
        for _ in range(60):
            word = rng.choice(base[: rng.randrange(2, 60)])
            if rng.random() < 0.2:
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcÀ×") + word[at:], word[:at] + "d" + word[at + 1 :]])
            said.append(word.upper() if rng.random() < 0.1 else word)
        docs.append((i if i % 9 else None, rng.choice([" ", ", ", "1"]).join(said)))
    long_ = "lengthy" * 30
    docs += [(500, f"{long_} {long_} {long_}x {long_}x {long_}x {long_} {long_[:-1]} ".join(["", "", ""]))]
    docs += [(501, None), (502, ""), (503, " \n"), (504, "ΑΒΓΔΕ abcde\U0001f600abcde")]
    return docs + docs[:5]


@pytest.mark.parametrize("node_words", [3, 40_000])
def test_small_texts(spark, node_words):
    docs = texts()
    schema = "doc_id bigint, text string, word string, n bigint, node string"
    df = spark.createDataFrame([(i, t, "w", 1, "z") for i, t in docs], schema).repartition(4)
    words = vocabulary(docs)
    assert listed(spelling.variants(spelling.vocabulary(df), node_words=node_words)) == variants(words)


def test_letters_are_dropped(spark):
    docs = [(i, "spelling Spelling variant") for i in range(300)]
    words = vocabulary(docs, loss=2, count=1)
    found = spelling.vocabulary(spark.createDataFrame(docs, "doc_id bigint, text string"), loss=2, least_count=1)
    assert {r["word"]: r["n"] for r in found.collect()} == words


@pytest.mark.parametrize("large", [0, 128])
def test_words_of_the_same_letters(large, monkeypatch):
    monkeypatch.setattr(spelling, "LARGE_LEAF", large)
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"a" * 70, "a" * 71, "a" * 70 + "b"})
    a, b = spelling.matches(words, words, ["a", "b", ""])
    pairs = [(words[i], words[j]) for i, j in zip(a, b)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(x, y) for x in words for y in words if one_edit(x, y)}


def test_chains_of_forms(spark):
    rows = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("zzzzz", 5)]
    found = spelling.variants(spark.createDataFrame(rows, "word string, n bigint"))
    assert listed(found) == variants(dict(rows))


def test_near():
    assert spelling.near("abcde", "abcd") and spelling.near("abcd", "xabcd") and spelling.near("abxde", "abcde")
    assert not spelling.near("abcde", "abcde") and not spelling.near("abcde", "abdce") and not spelling.near("abcde", "abc")
