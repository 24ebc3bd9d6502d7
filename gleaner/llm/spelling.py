"""Spelling variants: words one edit apart, found with a trie of letter-group counts.

Letters are dealt into GROUPS groups of about equal weight.  A word is the path
of its group counts; words with the same counts share a leaf.  One inserted,
deleted or replaced letter raises at most one count by one and lowers at most one
by one, so a depth-first search that may spend one surplus and one deficit meets
every word that is one edit away.  Words at the leaves are verified letter by
letter; in a large leaf, by their spellings with one letter left out.

The trie is cut at a depth where no node holds more than NODE_WORDS words.  A
word is sent to the nodes that its budget can reach, and only to those after its
own in the order of counts, so each pair of words meets once.  A node that is too
large at full depth (words of the same letters) is dealt out in parts, and its
visitors go to each of them.

Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, of which A-Z are
lower-cased; some occurrences lose a letter (see `vocabulary`).  Null texts are
empty; a null id counts as an empty one; repeated rows count each.  Ties of a
word's form go to the smallest word in code-point order.  Empty tables give empty
results.  Only the counts of letters, at most 90 of them, come to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import let, whole, written
from gleaner.operators.joins import stack

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = r"[A-Za-zÀ-ÿ]+"
LOSS = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
GROUPS = 16
NODE_WORDS = 40_000
FIRST_DEPTH = 2
#: Words of a leaf from which spellings are looked up, not compared.
LARGE_LEAF = 128
FRONTIER = 1 << 17
WIDE = 64


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: int = LOSS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n): the words of all texts.

    Where `loss` divides h, the CRC-32 of "<id>:<word>", an occurrence loses its
    letter number h % length.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(whole(text_col), F.lit(LETTERS), F.lit(0))).alias("run"),
    ).where(F.length("run") >= least_length)
    # Most runs have no capital: only the others are translated letter by letter.
    lower = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, UPPER.lower()))
    said = runs.select("id", lower.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % loss == 0, shorter).otherwise(F.col("run"))
    return (
        said.select(word.alias("word")).where(F.length("word") >= least_length)
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    )


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters in `groups` groups of about equal weight, by their counts in all words."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    counts = sorted(((r["count"], r["letter"]) for r in letters.collect() if r["letter"]), reverse=True)
    out, weight = [""] * groups, [0] * groups
    for count, letter in counts:
        lightest = min(range(groups), key=lambda g: (weight[g], g))
        out[lightest] += letter
        weight[lightest] += count
    return out


def near(a: str, b: str) -> bool:
    """Does exactly one inserted, deleted or replaced letter lie between two words?"""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long_ = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long_)) if x != y), len(short))
    return long_[at + 1 :] == short[at + (len(a) == len(b)) :]


class Trie:
    """Words by their counts of letters in each group, one level per group."""

    def __init__(self, words: list[str], groups: list[str]):
        self.groups = groups
        counts = self.counts(words)
        order = np.lexsort(counts.T[::-1]) if len(words) else np.empty(0, np.int64)
        counts = counts[order]
        self.words = [words[i] for i in order]
        self.order = order
        self.base = int(counts.max(initial=0)) + 3
        self.keys: list[np.ndarray] = []
        node, changed = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        for level in range(len(groups)):
            changed[1:] |= counts[1:, level] != counts[:-1, level]
            new = np.cumsum(changed)
            first = np.flatnonzero(np.r_[True, changed[1:]]) if len(words) else np.empty(0, np.int64)
            # A child is found by its parent and its count; sorted words give sorted keys.
            self.keys.append(node[first] * self.base + counts[first, level])
            node = new
        self.starts = np.r_[first, len(words)]

    def counts(self, words: list[str]) -> np.ndarray:
        table = np.zeros(256, np.int64)
        for g, letters in enumerate(self.groups):
            table[list(letters.encode("latin-1"))] = g
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        size = len(words) * len(self.groups)
        return np.bincount(owner * len(self.groups) + table[codes], minlength=size).reshape(len(words), len(self.groups))

    def reached(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, leaf) wherever a budget of one surplus and one deficit suffices, depth first."""
        counts = self.counts(words)
        none = np.zeros(len(words), np.int8)
        stack_ = [(0, np.arange(len(words)), np.zeros(len(words), np.int64), none)] if len(words) and self.words else []
        while stack_:
            level, asked, node, spent = stack_.pop()
            if level == len(self.groups):
                yield asked, node
                continue
            if len(asked) > FRONTIER:
                half = len(asked) // 2
                for part in (slice(half, None), slice(0, half)):
                    stack_.append((level, asked[part], node[part], spent[part]))
                continue
            keys, parts = self.keys[level], []
            for change, price in ((0, 0), (1, 1), (-1, 2)):
                may = np.flatnonzero((spent & price) == 0) if price else np.arange(len(asked))
                count = counts[asked[may], level] + change
                key = node[may] * self.base + count
                child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[child] == key) & (count >= 0) & (count < self.base)
                parts.append((asked[may[hit]], child[hit], spent[may[hit]] | price))
            stack_.append((level + 1, *(np.concatenate(c) for c in zip(*parts))))


def _aligned(words: list[str], right: bool) -> np.ndarray:
    """Words as rows of letters, left- or right-aligned; longer words are cut and not used."""
    out = np.zeros((len(words), WIDE), np.uint8)
    for i, word in enumerate(words):
        if len(word) <= WIDE:
            letters = np.frombuffer(word.encode("latin-1"), np.uint8)
            if right:
                out[i, WIDE - len(word) :] = letters
            else:
                out[i, : len(word)] = letters
    return out


class Verifier:
    """Which of the words of a leaf are one edit away from the words that reach it."""

    def __init__(self, asked: list[str], words: list[str]):
        self.asked, self.words = asked, words
        self.sides = [(_aligned(asked, right), _aligned(words, right)) for right in (False, True)]
        self.lengths = np.array([len(w) for w in asked]), np.array([len(w) for w in words])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Compare pairs letter by letter."""
        if not len(a):
            return np.zeros(0, bool)
        la, lb = self.lengths[0][a], self.lengths[1][b]
        least = np.minimum(la, lb)
        (left_a, left_b), (right_a, right_b) = self.sides
        width = min(int(max(la.max(initial=0), lb.max(initial=0))), WIDE)
        ahead = left_a[a, :width] != left_b[b, :width]
        behind = (right_a[a] != right_b[b])[:, WIDE - width :][:, ::-1]
        run = lambda other: np.where(other.any(1), other.argmax(1), width)
        alike = np.minimum(run(ahead), least) + np.minimum(run(behind), least)
        ok = np.where(la == lb, ahead.sum(1) == 1, (np.abs(la - lb) == 1) & (alike >= least))
        for i in np.flatnonzero(np.maximum(la, lb) > WIDE):
            ok[i] = near(self.asked[a[i]], self.words[b[i]])
        return ok

    def looked_up(self, a: np.ndarray, members: range) -> tuple[list[int], list[int]]:
        """The same in a large leaf: by spellings with one letter left out, without comparing all pairs."""
        less = lambda w: {(i, w[:i] + w[i + 1 :]) for i in range(len(w))}
        whole_, at, rest = defaultdict(list), defaultdict(list), defaultdict(set)
        for m in members:
            word = self.words[m]
            whole_[word].append(m)
            for i, left in less(word):
                at[i, left].append(m)
                rest[left].add(m)
        found = set()
        for q in a:
            word = self.asked[q]
            found.update((q, m) for m in rest.get(word, ()))
            for i, left in less(word):
                found.update((q, m) for m in at.get((i, left), ()) if self.words[m] != word)
                found.update((q, m) for m in whole_.get(left, ()))
        return [q for q, _ in found], [m for _, m in found]


def matches(asked: list[str], words: list[str], groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(asked, word) places of all pairs one edit apart."""
    trie = Trie(words, groups)
    check = Verifier(asked, trie.words)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, leaf in trie.reached(asked):
        size = trie.starts[leaf + 1] - trie.starts[leaf]
        large = size > LARGE_LEAF
        for node in np.unique(leaf[large]):
            q, m = check.looked_up(a[large & (leaf == node)], range(trie.starts[node], trie.starts[node + 1]))
            left.append(np.array(q, np.int64))
            right.append(np.array(m, np.int64))
        a, leaf, size = a[~large], leaf[~large], size[~large]
        for part in np.array_split(np.arange(len(a)), int(size.sum()) // FRONTIER + 1):
            q = np.repeat(a[part], size[part])
            place = np.arange(len(q)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            m = np.repeat(trie.starts[leaf[part]], size[part]) + place
            ok = check.pairs(q, m)
            left.append(q[ok])
            right.append(m[ok])
    return np.concatenate(left), trie.order[np.concatenate(right)]


def _reachable(depth: int) -> Column:
    """The changes of the first `depth` counts that a budget allows, none or with a surplus first."""
    steps = [[0] * depth]
    for i in range(depth):
        steps.append([int(g == i) for g in range(depth)])
        for j in range(depth):
            if i < j:
                steps.append([int(g == i) - int(g == j) for g in range(depth)])
    return F.array(*[F.array(*[F.lit(x) for x in step]) for step in steps])


def links(words: DataFrame, groups: list[str], node_words: int = NODE_WORDS) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (word, n) one edit apart, once."""
    counts = F.array(*[(F.length("word") - F.length(F.translate("word", g, ""))) if g else F.lit(0) for g in groups])
    counted = written(words.select("word", "n", counts.cast("array<int>").alias("counts")))
    depth = FIRST_DEPTH
    while True:
        prefix = F.slice("counts", 1, depth)
        sizes = counted.groupBy(F.array_join(prefix, ",").alias("node")).agg(F.ceil(F.count("*") / node_words).cast("int").alias("parts"))
        if depth >= len(groups) or (sizes.agg(F.max("parts")).first()[0] or 0) <= 1:
            break
        depth = min(depth + 2, len(groups))
    sizes = written(sizes)
    filed = counted.withColumn("node", F.array_join(prefix, ",")).join(sizes, "node")
    members = filed.select("node", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "word", "n")
    moved = F.transform(_reachable(depth), lambda step: F.zip_with(prefix, step, lambda x, y: x + y))
    visits = counted.select("word", "n", F.posexplode(moved).alias("step", "to")).where(F.forall("to", lambda x: x >= 0))
    sent = visits.withColumn("node", F.array_join("to", ",")).join(sizes, "node")
    # Role 1 visits the word's own node, role 2 another one.
    role = F.when(F.col("step") == 0, 1).otherwise(2).alias("role")
    visitors = sent.select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), role, "word", "n")

    def run(table: pa.Table) -> pa.Table:
        role_ = table.column("role").to_numpy()
        own, far = table.filter(pa.array(role_ == 0)), table.filter(pa.array(role_ > 0))
        words_, asked = own.column("word").to_pylist(), far.column("word").to_pylist()
        a, b = matches(asked, words_, groups)
        # Inside a node both words of a pair ask; one of them counts.
        inside = far.column("role").to_numpy()[a] == 1
        once = np.array([not same or asked[i] < words_[j] for i, j, same in zip(a, b, inside)], bool)
        left, right = far.take(pa.array(a[once])), own.take(pa.array(b[once]))
        return pa.table({"a": left.column("word"), "a_n": left.column("n"), "b": right.column("word"), "b_n": right.column("n")})

    return stack(members, visitors).groupBy("node", "part").applyInArrow(run, "a string, a_n bigint, b string, b_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms.

    A form is more frequent than its word, so chains end.  Every round doubles
    the steps that are behind a word.
    """
    state = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = written(
            state.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        )
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(words: DataFrame, groups: int = GROUPS, node_words: int = NODE_WORDS) -> DataFrame:
    """words(word, n) -> (word, form, root, n, n_near, form_n).

    A word's form is its most frequent near word, if that is at least twice as
    frequent as the word.
    """
    words = written(words)
    pairs = written(links(words, letter_groups(words, groups), node_words))
    side = lambda word, other, n: F.struct(F.col(word).alias("word"), F.col(other).alias("near"), F.col(n).alias("near_n"))
    ends = pairs.select(F.explode(F.array(side("a", "b", "b_n"), side("b", "a", "a_n"))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    found = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            let(F.col("top"), lambda top: F.when(-top["less"] >= 2 * F.col("n"), top)).alias("top"),
        ).select("word", "n", "n_near", F.col("top.near").alias("form"), (-F.col("top.less")).alias("form_n"))
    )
    ends_at = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends_at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
