"""Queries over documents against brute force, on a small corpus of odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import anchors, mixing, packing, quality, queries, secrets, sharding, simhash, substrings, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    df = queries.QUERIES[name](spark, empty)
    assert df.columns and df.count() == 0


# -- secrets ---------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark, sf_dir, plain):
    want = Counter()
    for doc_id, text in plain:
        spans = base_spans(text or "")
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        kinds = [k for _, k, _ in spans]
        want[doc_id, kinds.count(0), kinds.count(1), kinds.count(2), sha(listed)] += 1
    found = queries.op1_secret_scan(spark, sf_dir)
    assert rows_of(found.drop("spans")) == want
    for r in found.collect():
        base = [s for s in r["spans"].split(",") if s and not s.startswith("link")]
        assert sha(",".join(base)) == r["base_sha256"]


def scanned(spark, text, reach=secrets.REACH):
    df = spark.createDataFrame([(text,)], "text string")
    found = secrets.scan(df, reach=reach)
    return found.select(secrets.listed(found["__spans"]), secrets.redact(found["text"], found["__spans"])).first()


def test_weak_parts_need_their_complement(spark):
    alone, _ = scanned(spark, "please log in: user=alice and be well")
    assert alone == ""
    both, clean = scanned(spark, "user=alice password=abcd12 at https://db.example/x")
    assert both == "link_id:0:10,link_short:11:26,link_host:30:50"
    assert clean == "[secret] [secret] at [secret]"
    far, _ = scanned(spark, "user=alice" + " " * 300 + "password=abcd12")
    assert far == ""
    near, _ = scanned(spark, "user=alice" + " " * 300 + "password=abcd12", reach=400)
    assert near == "link_id:0:10,link_short:310:325"
    endpoint, _ = scanned(spark, "https://db.example/x token=abcdefgh99")
    assert endpoint == "assign:21:37"  # an endpoint needs an identifier, too
    with_secret, _ = scanned(spark, "\U0001f511 account: bob, key Zq9XkPm4Rt7Vw2Yb8Nc5")
    assert with_secret == "link_id:2:14,link_secret:20:40"


@pytest.mark.parametrize(
    "text",
    [
        "see https://github.com/apache/Spark/pull/12345 for it",
        "login=Zq9XkPm4Rt7Vw2Yb8Nc5 is all",
        "user=alice wrote https://github.com/apache/Spark/pull/12345",
        "https://h.example/x and https://github.com/apache/Spark/pull/12345",
        "https://h.example/?user=alice",
    ],
)
def test_a_stretch_of_text_does_not_complete_itself(spark, text):
    assert scanned(spark, text) == ("", text)


def test_parts_beside_overlapping_ones_still_complete(spark):
    key = "Zq9XkPm4Rt7Vw2Yb8Nc5"
    listed, _ = scanned(spark, f"user=bob login={key}")
    assert listed == "link_id:0:8,link_secret:15:35"  # nothing beside it completes the second account
    listed, _ = scanned(spark, f"{key},login={key},{key}")
    assert listed == "link_secret:0:20,link_id:21:47,link_secret:48:68"
    listed, _ = scanned(spark, f"https://github.com/apache/Spark/pull/12345 {key}")
    assert listed == "link_secret:43:63"


def test_redaction_of_overlapping_and_many_spans(spark):
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    assert scanned(spark, text)[1] == '[secret]" end'
    many = " ".join(f"token=abcdefgh{i:04d}" for i in range(1500))
    listed, clean = scanned(spark, many)
    assert clean == " ".join(["[secret]"] * 1500)
    assert listed == ",".join(f"assign:{19 * i}:{19 * i + 18}" for i in range(1500))


# -- fingerprints -----------------------------------------------------------------


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    names = sorted(set(prints))
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            if (a ^ names[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return {name: root(i) for i, name in enumerate(names)}


def test_simhash(spark, sf_dir, plain):
    prints = [(doc_id, slow_fingerprint(text or "")) for doc_id, text in plain]
    group = components([p for _, p in prints])
    first = {}
    for doc_id, p in prints:
        if doc_id is not None:
            first[group[p]] = min(doc_id, first.get(group[p], doc_id))
    want = Counter((doc_id, f"{p:016x}", first.get(group[p])) for doc_id, p in prints)
    assert rows_of(queries.op2_simhash_near_dedup(spark, sf_dir)) == want


@pytest.mark.parametrize("part", [1024, 4])
def test_links_connect_what_is_near(spark, part):
    rng = np.random.default_rng(2)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint bigint")
    edges = [tuple(np.uint64(v % (1 << 64)) for v in (r.a, r.b)) for r in simhash.links(df, part=part).collect()]
    assert all((int(a) ^ int(b)).bit_count() <= 64 for a, b in edges)
    got = dict(zip(sorted(prints), range(len(prints))))
    parent = list(range(len(got)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(got[int(a)])] = root(got[int(b)])
    groups = lambda label: sorted(sorted(k for k in prints if label(k) == g) for g in {label(k) for k in prints})
    want = components(prints)
    assert groups(lambda k: root(got[k])) == groups(lambda k: want[k])


def test_one_row_of_each_component_stays(spark, corpus, plain):
    prints = [(doc_id, text, slow_fingerprint(text or "")) for doc_id, text in plain]
    group = components([p for _, _, p in prints])
    kept = simhash.kept(corpus)
    assert kept.columns == corpus.columns
    rows = kept.collect()
    assert Counter(group[slow_fingerprint(r["text"] or "")] for r in rows) == Counter(set(group.values()))
    for r in rows:
        own = [d for d, _, p in prints if group[p] == group[slow_fingerprint(r["text"] or "")] and d is not None]
        assert r["doc_id"] == min(own, default=None)


# -- repeated strings and windows ---------------------------------------------------


def removed(units, length):
    """Marks of the units to remove, for (id, units) rows; a null id is the largest."""
    first = {}
    for doc_id, u in units:
        key = LAST if doc_id is None else doc_id
        for i in range(len(u) - length + 1):
            window = tuple(u[i : i + length])
            first[window] = min(key, first.get(window, key))
    out = []
    for doc_id, u in units:
        key = LAST if doc_id is None else doc_id
        mark = [False] * len(u)
        for i in range(len(u) - length + 1):
            if first[tuple(u[i : i + length])] < key:
                mark[i : i + length] = [True] * length
        out.append(mark)
    return out


def test_suffix_dedup(spark, sf_dir, plain):
    units = [(d, (t or "").encode()) for d, t in plain]
    want = Counter()
    for (doc_id, data), mark in zip(units, removed(units, 50)):
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        want[doc_id, len(data), sum(mark), spans, sha(bytes(b for b, m in zip(data, mark) if not m))] += 1
    assert rows_of(queries.op3_suffix_dedup(spark, sf_dir)) == want


@pytest.mark.parametrize(("chunk", "group"), [(1 << 16, 1 << 18), (1, 1 << 18), (8, 12), (1, 1)])
def test_suffix_sorting_in_small_pieces(spark, chunk, group, monkeypatch):
    """Texts of few letters share very many grams; any cut into chunks gives the same removal."""
    import random

    rng = random.Random(chunk + group)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(5, 60)))) for i in range(60)]
    docs += [(60 + i, docs[i][1][3:] + "a") for i in range(20)] + [(90, "a" * 200), (91, "a" * 90)]
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffixes.removal(rows, length=12, gram=4).collect()}
    units = [(d, t.encode()) for d, t in docs]
    for (doc_id, _), mark in zip(units, removed(units, 12)):
        edges = np.flatnonzero(np.diff(np.r_[False, mark, False])).reshape(-1, 2)
        assert got[doc_id] == [tuple(e) for e in edges.tolist()], doc_id


def test_substring_dedup(spark, sf_dir, plain):
    units = [(d, (t or "").encode().split()) for d, t in plain]
    want = Counter()
    for (doc_id, words), mark in zip(units, removed(units, 50)):
        want[doc_id, len(words), sum(mark), sha(b" ".join(w for w, m in zip(words, mark) if not m))] += 1
    assert rows_of(queries.op6_substring_dedup(spark, sf_dir)) == want


def test_substring_dedup_of_few_words(spark):
    import random

    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(2, 60)))) for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["id"]: r["spans"] for r in substrings.removal(rows, length=12, gram=4).collect()}
    units = [(d, t.split()) for d, t in docs]
    for (doc_id, _), mark in zip(units, removed(units, 12)):
        edges = np.flatnonzero(np.diff(np.r_[False, mark, False])).reshape(-1, 2)
        assert [tuple(s) for s in got[doc_id]] == [tuple(e) for e in edges.tolist()]


def test_windows_have_the_hash_of_their_content():
    rng = np.random.default_rng(0)
    units = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    units[300:400] = units[50:150]
    windows = anchors.Ranges(units).windows(20)
    assert (windows[300:381] == windows[50:131]).all() and len(np.unique(windows)) == 481 - 81
    b = anchors.blocks(anchors.Ranges(units), np.array([500]), 20, 6)
    assert b.first[0] == 0 and b.last[-1] == 480 and (b.first[1:] == b.last[:-1] + 1).all()
    assert ((b.place >= b.last) & (b.place <= b.first + 14)).all()
    assert len(anchors.blocks(anchors.Ranges(units[:19]), np.array([19]), 20, 6).first) == 0
    # Documents behind each other have the blocks that each has alone.
    ends = np.array([0, 30, 30, 49, 200, 219, 500])
    many = anchors.blocks(anchors.Ranges(units), ends, 20, 6)
    for doc, (start, end) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        own, alone = many.take(many.doc == doc), anchors.blocks(anchors.Ranges(units[start:end]), np.array([end - start]), 20, 6)
        assert (own.first - start == alone.first).all() and (own.last - start == alone.last).all()
        assert (own.content == alone.content).all() and (own.anchor == alone.anchor).all()


# -- rules ------------------------------------------------------------------------


def test_quality(spark, sf_dir, plain):
    want = Counter()
    for doc_id, text in plain:
        text = text or ""
        words, seen, again = WORD.findall(text), set(), 0
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        n = len(words)
        failed = n < 10 or 100 * len(covered) > 20 * n
        want[doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed] += 1
    found = queries.op5_quality_rules(spark, sf_dir)
    assert rows_of(found.drop("kept")) == want
    assert found.where("kept and base_failed").count() == 0
    assert found.where("kept").count() > 50


def test_policies_and_ablations(corpus):
    rows = quality.ledger(corpus).cache()
    policy = quality.POLICIES["v1"]
    failed = [r["failed"] for r in rows.collect()]
    for r in quality.ablations(rows, policy).collect():
        bit = quality.BIT[r["rule"]]
        assert r["failed"] == sum(bool(f & bit) for f in failed)
        assert r["failed_alone"] == sum(f & policy.mask == bit for f in failed)
        assert r["kept_without"] == sum(not f & policy.mask & ~bit for f in failed)
    kept = quality.kept(corpus)
    assert kept.columns == corpus.columns and kept.count() == sum(not f & policy.mask for f in failed)


# -- shards, mixes, sequences -------------------------------------------------------


def test_shards(spark, sf_dir, plain):
    rows = queries.op4_hilbert_shards(spark, sf_dir).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in plain)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(slots) == set(range(40))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    from itertools import product

    places = sharding.curve(dimensions, bits)
    assert sorted(places) == list(range(1 << dimensions * bits))
    walk = [cell for _, cell in sorted(zip(places, product(range(1 << bits), repeat=dimensions)))]
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(walk, walk[1:]))


def test_shard_ranges_prune(corpus):
    placed = sharding.shard(corpus, shards=10)
    ranges = sharding.ranges(placed).collect()
    assert sum(r["rows"] for r in ranges) == corpus.count()
    wide = sum(1 for r in ranges if (r["min_source"], r["max_source"]) == ("a", "é"))
    assert wide < len(ranges)


def test_strings_that_begin_alike_are_told_apart(spark):
    names = [f"https://common_crawl_{i:02}/" for i in range(20)]
    docs = spark.createDataFrame(
        [(i, "t", names[0] if i % 3 == 0 else names[i % 20], i % 2) for i in range(6000)] + [(None, None, None, None)] * 5,
        "doc_id bigint, text string, source string, lang int",
    )
    placed = sharding.shard(docs, dimensions=("source", "lang"))
    ranges = sharding.ranges(placed, ("source", "lang")).collect()
    assert sum(r["rows"] for r in ranges) == 6005
    held = {r["__shard"]: r["n"] for r in placed.groupBy("__shard").agg(F.countDistinct("__d0").alias("n")).collect()}
    assert len(held) == 40 and max(held.values()) <= 4
    assert len({(r["min_source"], r["max_source"]) for r in ranges}) > 10


def test_mix(spark, sf_dir, corpus, plain):
    rows = queries.op8_pareto_mix(spark, sf_dir).collect()
    assert rows_of(spark.createDataFrame(rows)) == rows_of(queries.op8_pareto_mix(spark, sf_dir))
    sizes, largest = Counter(), Counter()
    for r in corpus.select("source", "text").collect():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        largest[r["source"]] = max(n, largest[r["source"]])
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in rows:
        source = by_size[r["source_size"]]
        taken[source] += r["taken"]
        assert r["target"] == pytest.approx(target[source]) and r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
    for s in names:
        assert abs(taken[s] - target[s]) <= max(largest[s], 1)


def test_mix_keeps_columns_and_order_of_rank(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2 and i < 900]) for i in range(1000)], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs, weights=(1, 1)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "source", "__size", "__source_size", "__target", "__copies"}
    assert sum(r["__copies"] for r in rows if r["source"] == "b") in range(499, 502)


def test_inclusion_odds_decide_who_is_taken(spark):
    """The documents taken are those of a Pareto order sample written in plain Python, and lean towards long texts."""
    rng = random.Random(12)
    sizes = [rng.choice((5, 20, 100, 400, 2000)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, "w " * n, "ab"[i % 2]) for i, n in enumerate(sizes)], "doc_id bigint, text string, source string")
    taken = {p: {r["doc_id"]: r["__copies"] for r in mixing.mix(docs, pull=p).select("doc_id", "__copies").collect()} for p in (0.0, 1.0)}
    for pull, copies in taken.items():
        total = {s: sum(sizes[s::2]) for s in (0, 1)}
        for s, weight in ((0, 1), (1, 2)):
            target = sum(total.values()) * weight / 3
            sure, part = divmod(target / total[s], 1)
            mean = sum(n * (n * 1024 // (n + 256)) for n in sizes[s::2]) / total[s]
            ranks = {}
            for i in range(s, len(sizes), 2):
                chance = part * (1 + (1 - part) * (pull * (sizes[i] * 1024 // (sizes[i] + 256) - mean) / 1024))
                u = (int(hashlib.md5(f"8:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranks[i] = u / (1 - u) * (1 - chance) / chance
                assert 0 < chance < 1
            order, at, best = sorted(ranks, key=ranks.get), 0, (target - sure * total[s], 0)
            for n, i in enumerate(order, 1):
                at += sizes[i]
                best = min(best, (abs(target - sure * total[s] - at), n))
            assert {i for i in ranks if copies[i] > sure} == set(order[: best[1]])
    share = {p: [sum(c[i] for i, n in enumerate(sizes) if n == size) for size in (5, 2000)] for p, c in taken.items()}
    assert share[1.0][0] < share[0.0][0] and share[1.0][1] >= share[0.0][1]
    assert taken[0.0] != taken[1.0]


def test_pack(spark, sf_dir, plain):
    import public_tokenizers

    slow = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for doc_id, text in plain:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    rows = queries.op9_best_two_fit(spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 1


def test_special_tokens_and_long_stretches_have_the_ids_of_the_definition():
    import public_tokenizers

    slow = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.encoder(None, "byte_bpe_50k")
    for text in ("", "a <|endoftext|> b", "x" * 9000, " " * 6000 + "y", "é" * 5000, "\U0001f600   z\n\n  t", "'s 're I'LL 12345"):
        assert ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_two_small_documents_replace_one_that_leaves_a_gap():
    uses = packing.plan({6: 1, 3: 1, 2: 2}, size=10)
    assert sorted(u.length for u in uses if u.sequence == 0) == [2, 6] and max(u.sequence for u in uses) == 1
    assert {u.length: u.offsets for u in uses if u.sequence == 0}[2] == (6, 8)


def test_plans_fill_sequences():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 1025, 60), rng.integers(1, 3000, 60))}
        uses = packing.plan(counts)
        placed = Counter()
        last = max(u.sequence for u in uses)
        assert last + 1 >= -(-sum(n * c for n, c in counts.items()) // 1024) // 1
        for u in uses:
            placed[u.length] += len(u.offsets)
        assert set(placed) == set(counts)
