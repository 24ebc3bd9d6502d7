"""Every stage of the pipeline against plain Python, each on what its predecessor kept."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import tokenizers

from gleaner.llm import nearcopies, secrets
from tests.llm.test_documents import WORD, base_spans
from tests.llm.test_tables import near_components, slow_shingles


def passes_rules(text):
    words, seen, again = WORD.findall(text), set(), 0
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    for line in lines:
        again += line in seen
        seen.add(line)
    n, chars = len(words), sum(map(len, words))
    capitals = sum(c.isupper() for c in text)
    return (
        n >= 10
        and 5 * len(covered) <= n
        and 2 * n <= chars <= 20 * n
        and 4 * len(re.findall(r"[#*$%&|<>]", text)) <= n
        and 10 * again <= 3 * len(lines)
        and 2 * capitals <= chars
    )


def counted(rows):
    return Counter(tuple(r)[:5] for r in rows)  # lists cannot be counted


@pytest.fixture(scope="module")
def stages(spark, corpus):
    """Rows before the first stage and after each one."""
    docs, out = corpus, [corpus.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        out.append(docs.collect())
    return out


def test_rules_keep_what_plain_rules_keep(stages):
    before, after = stages[0:2]
    assert counted(after) == counted(r for r in before if passes_rules(r["text"] or ""))


def test_one_text_of_each_group_stays(stages):
    before, after = stages[1:3]
    group = near_components([slow_shingles(r["text"] or "") for r in before])
    least = {}
    for r in before:
        g = group[slow_shingles(r["text"] or "")]
        least[g] = min((r["doc_id"] is None, r["doc_id"] or 0), least.get(g, (True, 1 << 62)))
    assert Counter(r["doc_id"] for r in after) == Counter(None if none else i for none, i in least.values())
    assert not counted(after) - counted(before)


def test_spans_are_replaced_and_nothing_else(stages):
    before, after = stages[2:4]
    assert len(before) == len(after)
    left = Counter(r["text"] for r in after)
    for r in before:
        text, clean, at = r["text"], [], 0
        spans = base_spans(text or "")
        for start, _, end in spans:
            if start >= at:
                clean += [text[at:start], secrets.PLACEHOLDER]
            elif end > at:
                clean[-1] = secrets.PLACEHOLDER
            at = max(at, end)
        want = "".join([*clean, text[at:]]) if spans else text
        if "user=" not in (text or ""):  # links of weak parts have tests of their own
            assert left[want] > 0
            left[want] -= 1


def test_sources_come_near_their_targets(stages):
    before, after = stages[3:5]
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in after:
        taken[r["source"]] += size(r)
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, full = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        share = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / max(sum(weight[s] for s in names if s not in full), 1)
        over = {s for s in names if s not in full and share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert abs(taken[s] - (3 * sizes[s] if s in full else share * weight[s])) <= max(largest[s], 1)
    had = counted(before)
    assert all(n <= 3 * had[r] for r, n in counted(after).items())


def test_pieces_are_those_of_the_mixed_documents(stages):
    import public_tokenizers

    before, after = stages[4:6]
    slow = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for r in before:
        ids = np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in after) == want
    bins = defaultdict(list)
    for r in after:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        ends = np.cumsum([length for _, length in sorted(held)])
        assert [offset for offset, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= -(-total // 1024) + 1


# -- large groups of candidates -----------------------------------------------------


def test_variants_of_a_template_are_sent_a_few_times(spark, monkeypatch):
    """One word changed: one group, whose texts are not sent to each other."""
    template = [f"w{i}" for i in range(300)]
    texts = [" ".join([*template[: i % 300], f"x{i}", *template[i % 300 + 1 :]]) for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sent, plain = [], nearcopies._compared

    def counting(cells, *args, **how):
        sent.append(cells.count())
        return plain(cells, *args, **how)

    monkeypatch.setattr(nearcopies, "_compared", counting)
    monkeypatch.setattr(nearcopies.verified, "__defaults__", (*nearcopies.verified.__defaults__[:2], 16))
    assert [r["doc_id"] for r in nearcopies.kept(docs).collect()] == [0]
    assert len(sent) > 1 and sum(sent) <= 3 * len(texts)


def test_pages_that_share_half_of_their_words_stay_apart_without_pairs(spark, monkeypatch):
    """All share a template and are candidates, none is alike: none reaches the pairs of parts."""
    rng = np.random.default_rng(4)
    template = " ".join(f"w{i}" for i in range(60))
    own = [" ".join(f"v{j}" for j in rng.integers(0, 1 << 40, 40)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"{template} {text}") for i, text in enumerate([*own, own[7] + " end"])], "doc_id bigint, text string")
    sent, plain = [], nearcopies._compared

    def counting(cells, *args, **how):
        sent.append((cells.count(), how))
        return plain(cells, *args, **how)

    monkeypatch.setattr(nearcopies, "_compared", counting)
    monkeypatch.setattr(nearcopies.verified, "__defaults__", (*nearcopies.verified.__defaults__[:2], 8))
    assert sorted(r["doc_id"] for r in nearcopies.kept(docs).collect()) == list(range(300))
    [(rows, _)] = [s for s in sent if s[1]]
    assert rows < 30
