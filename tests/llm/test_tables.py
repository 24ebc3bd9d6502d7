"""Queries over pages and vectors, and the pipeline."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from gleaner.llm import nearcopies, neighbours, queries, simhash, warc


def test_archives(spark, sf_dir):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    largest = {}
    for page_id, payload in pages:
        if page_id is not None:
            largest[payload] = max(page_id, largest.get(payload, page_id))
    want = Counter()
    for page_id, payload in pages:
        first = largest.get(payload, page_id)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want[page_id, len(payload), digest, *(("response", None) if page_id == first else ("revisit", first))] += 1
    assert Counter(tuple(r) for r in queries.op7_warc_normaliser(spark, sf_dir).collect()) == want


def test_members_can_be_read_alone_and_in_a_row(spark, sf_dir, tmp_path):
    root = tmp_path.as_uri()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole = warc.write(warc.planned(pages).coalesce(1), root)
    done = warc.normalise(whole, root).collect()
    [archive], [index] = (list((tmp_path / "members").glob(g)) for g in ("*.warc.gz", "*.idx"))
    assert len(done) == 1 and done[0]["records"] == pages.count()
    [source] = (tmp_path / "whole").iterdir()
    stream = zlib.decompressobj(31)
    text = stream.decompress(source.read_bytes())
    assert stream.eof and not stream.unused_data  # one gzip stream
    chunks = [archive.read_bytes()[i : i + 7] for i in range(0, archive.stat().st_size, 7)]
    assert b"".join(warc.inflated(chunks)) == text == b"".join(warc.records(warc.inflated(chunks)))
    assert len(index.read_text().splitlines()) == pages.count()


def test_records_have_dates_and_ids_of_their_own():
    heads = [warc.headers(warc.record(7, "u", b"x", None, False, "2024-05-06T07:08:09Z").partition(b"\r\n\r\n")[0]) for _ in range(2)]
    heads.append(warc.headers(warc.record(None, None, b"", 9, True).partition(b"\r\n\r\n")[0]))
    assert len({h["WARC-Record-ID"] for h in heads}) == 3
    assert [h["WARC-Date"] for h in heads] == ["2024-05-06T07:08:09Z"] * 2 + [warc.DATE]
    assert heads[0]["X-Page-ID"] == "7" and "X-Page-ID" not in heads[2] and heads[2]["X-Refers-To-Page"] == "9"


@pytest.mark.parametrize("cut", [1, 40])
def test_cut_archives_are_an_error(cut):
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = squeeze.compress(warc.record(1, "u", b"x" * 500, None, False)) + squeeze.flush()
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(warc.inflated([data[:-cut]])))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    plan = {r["page_id"]: r["refers_to"] for r in warc.planned(pages, smallest=3).collect()}
    assert plan == {1: None, 2: None, 3: 4, 4: None}


# -- neighbours ---------------------------------------------------------------------


def exact(rows, query, vector, k=10):
    near = [(float(np.sqrt(((np.array(v) - vector) ** 2).sum())), i) for i, v in rows if i != query and len(v) == len(vector)]
    return sorted(near)[:k]


def test_neighbours(spark, sf_dir):
    rows = [
        (r["vec_id"], [float(x) for x in r["embedding"]])
        for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
        if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])
    ]
    got = defaultdict(list)
    for r in queries.op10_learned_partitions(spark, sf_dir).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    asked = [(i, np.array(v)) for i, v in rows if i % 100 == 0]
    assert set(got) == {i for i, _ in asked}
    found = total = 0
    for query, vector in asked:
        want, have = exact(rows, query, vector), sorted(got[query])
        assert [r for r, _, _ in have] == list(range(1, len(want) + 1))
        assert [(s, i) for _, s, i in have] == sorted((s, i) for _, s, i in have)
        for _, score, i in have:
            assert score == pytest.approx(np.sqrt(((np.array(dict(rows)[i]) - vector) ** 2).sum()), abs=1e-12)
        found, total = found + len({i for _, i in want} & {i for _, _, i in have}), total + len(want)
    assert found / total >= 0.9


def test_parts_are_balanced_and_learned():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(4000, 8)) + 5 * rng.integers(0, 3, (4000, 1))
    label = neighbours.balanced_parts(vectors, neighbours.graph(vectors, 10), 16)
    assert np.bincount(label, minlength=16).max() <= 1.15 * 4000 / 16
    router = neighbours.fit(vectors, parts=16)
    assert router.probes < 16
    assert neighbours.fit(vectors[:50], parts=16) is None


def test_very_many_ties_keep_the_smallest_ids(spark):
    rows = [(i, [1.0, 1.0]) for i in range(500)] + [(1000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = neighbours.search(df, "vec_id = 1000").orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(10)) and {r["score"] for r in found} == {1.0}


def test_cells_of_any_size_give_the_same(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = Counter(tuple(r) for r in neighbours.search(table, "vec_id % 100 = 0").collect())
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 2)
    assert Counter(tuple(r) for r in neighbours.search(table, "vec_id % 100 = 0").collect()) == want


# -- the pipeline --------------------------------------------------------------------


def test_stages_keep_the_columns_and_bear_empty_tables(spark, corpus, nothing):
    for docs in (corpus, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out = out.collect()
            assert bool(out) == (docs is corpus)


def test_secrets_are_gone(spark, corpus):
    clean = corpus_pipeline.redact_secrets(spark, corpus, "").collect()
    assert len(clean) == corpus.count()
    joined = " ".join(r["text"] or "" for r in clean)
    assert not re.search("[0-9a-f]{32}|AKIA[A-Z0-9]{12}|token = \"0", joined) and "[secret]" in joined
    before = {(r["doc_id"], r["text"]) for r in corpus.collect()}
    for r in clean:
        assert (r["doc_id"], r["text"]) in before or r["n_chars"] == len(r["text"])


def test_pipeline(spark, sf_dir, corpus):
    """Run over the tables: the sequences hold the documents that pass, as often as the mix takes them."""
    from tests.llm.test_documents import WORD, components, slow_fingerprint

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    good = corpus_pipeline.quality_rules(spark, corpus, "").collect()
    group = components([slow_fingerprint(r["text"] or "") for r in good])
    stay = {}
    for r in good:
        if r["doc_id"] is not None:
            g = group[slow_fingerprint(r["text"] or "")]
            stay[g] = min(r["doc_id"], stay.get(g, r["doc_id"]))
    assert {r["doc_id"] for r in packed if r["doc_id"] is not None} <= set(stay.values())
    words = sum(len(WORD.findall(r["text"] or "")) for r in simhash.kept(spark.createDataFrame(good, corpus.schema)).collect())
    assert sum(r["length"] for r in packed) > words * 0.8
    bins = Counter()
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 1024


def slow_shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_components(sets, up=4, down=5):
    """Of distinct sets: set to the place of its component."""
    names = sorted(set(sets), key=sorted)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            if down * len(a & names[j]) >= up * len(a | names[j]):
                parent[root(i)] = root(j)
    return {name: root(i) for i, name in enumerate(names)}


@pytest.mark.parametrize("part", [256, 3])
def test_stage_keeps_one_of_texts_alike_by_four_fifths(spark, part, monkeypatch):
    """Words are changed here and there: most similar pairs differ in more than 4 bits."""
    rng = np.random.default_rng(6)
    texts = []
    for size in (40, 120, 300, 700):
        for _ in range(6):
            words = [f"w{i}" for i in rng.integers(0, 3000, size)]
            texts.append(" ".join(words))
            for changes in (1, 1, 2, 3, 5, 8, 12, 20):
                other = list(words)
                for at in rng.choice(size, changes, replace=False):
                    other[at] = f"x{rng.integers(0, 3000)}"
                texts.append(" ".join(other))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)] + [(None, texts[0]), (900, None), (901, " "), (902, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(nearcopies.verified, "__defaults__", (*nearcopies.verified.__defaults__[:2], part))
    group = near_components([slow_shingles(t or "") for _, t in rows])
    want = {}
    for doc_id, text in rows:
        if doc_id is not None:
            g = group[slow_shingles(text or "")]
            want[g] = min(doc_id, want.get(g, doc_id))
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want.values())
    assert len(simhash.kept(docs).collect()) > len(kept) + 20  # what the fingerprints alone miss
