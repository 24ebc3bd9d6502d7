"""BM25 keyword index and search for many questions at once.

The index is sharded by chunk: all postings of a chunk lie in one hash
partition (or one bucket of the stored table), so every question is scored
where the postings are.  A task gathers the asked terms of each chunk, bounds
what chunks can offer each question, scores the chunks that may still enter its
list, and hands on k rows per question; pairs of question and chunk never become
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.functions.arrays import counted
from gleaner.functions.arrow_tokens import blocks, token_counts
from gleaner.operators.joins import fits_broadcast, join_lookup, many_tasks, stack, top_ranked
from gleaner.session import checkpointed

# Fixed values of the scoring rule.
K1 = 1.5
B = 0.75
IDF_FLOOR_SHARE = 0.25
INJECTED_BONUS = 100.0
SCORE_DIGITS = 9

# So many distinct keys go into the scan as a filter.
LISTED_KEYS = 500
# About so many keys are a batch of questions; so many batches, entries of lists and
# distinct keys are asked in one pass over the index.
QUESTION_KEYS = 250_000
PASS_BATCHES = 128
PASS_ENTRIES = 3_000_000
PASS_WORDS = 4_000_000
# Postings that a task holds in blocks, the questions of a group, and of a block and a
# group the (chunk, question) bounds, postings, uses of rare terms, scores, and terms of
# scored cells, that are held at once.
SLAB_POSTINGS = 1 << 19
GROUP_QUESTIONS = 1 << 10
BLOCK_CELLS = 1 << 21
BLOCK_POSTINGS = 1 << 18
BLOCK_USES = 1 << 16
SCORED_CELLS = 1 << 14
SCORED_TERMS = 1 << 18
SLACK = 1e-6
# A cell of a matrix product costs so much less than a posting that is met by itself.
DENSE_GAIN = 768
DENSE_CELLS = 1 << 22
# Lists are raised first where more chunks than so many times their length are near,
# so many questions at a time.
CROWDED = 4
SEED_COLUMNS = 128
# Kinds of questions, the terms that tell them, and how they are found.
LABELS = 16
LABEL_TERMS = 256
LABEL_SAMPLE = 4096
LABEL_ROUNDS = 10
# Named chunks come first: their value is their position less this.
NAMED_FIRST = 1e12

# Symbol names share the key column with terms; no term starts with this mark.
NAME_MARK = "="


def _body_and_names(enriched: bool) -> tuple[Column, Column]:
    """The text that is indexed, and the names a chunk answers to."""
    if enriched:
        return tx.index_text(F.col("text"), F.col("source_path"), F.col("symbol")), tx.symbol_keys(F.col("symbol"))
    return F.col("text"), F.array().cast("array<string>")


def forward_index(chunks: DataFrame, enriched: bool = True) -> DataFrame:
    """chunks(chunk_idx, text, source_path, symbol) -> (chunk_idx, terms, names, dl), one row per chunk."""
    body, names = _body_and_names(enriched)
    rows = chunks.select(
        "chunk_idx",
        counted(tx.tokens(body), "term", "tf").alias("terms"),
        names.alias("names"),
    )
    dl = F.aggregate("terms", F.lit(0), lambda acc, t: acc + t["tf"])
    return rows.repartition("chunk_idx").withColumn("dl", dl)


def postings(forward: DataFrame) -> DataFrame:
    """(key, chunk_idx, tf, dl): terms with their counts, and marked symbol names with tf 0."""
    entry = F.concat(
        F.transform("terms", lambda t: F.struct(t["term"].alias("key"), t["tf"].alias("tf"))),
        F.transform(
            "names",
            lambda n: F.struct(F.concat(F.lit(NAME_MARK), n).alias("key"), F.lit(0).alias("tf")),
        ),
    )
    return forward.select("chunk_idx", "dl", F.explode(entry).alias("e")).select(
        "e.key", "chunk_idx", "e.tf", "dl"
    )


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_idx, body, names) -> postings of a block of chunks, by key and chunk."""
    for batch in batches:
        for at, texts in blocks(batch.column(1)):
            chunk, names = batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts))
            counts = token_counts(texts)
            dl = np.bincount(counts.owner, counts.n, len(texts)).astype(np.int32)
            marked = pc.binary_join_element_wise(NAME_MARK, names.flatten().cast(pa.string()), "")
            named = pc.list_parent_indices(names).to_numpy().astype(np.int64)
            owner = pa.array(np.concatenate((named, counts.owner)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([marked, counts.terms.take(pa.array(counts.term))]),
                    chunk.take(owner),
                    pa.array(np.concatenate((np.zeros(len(named)), counts.n)).astype(np.int32)),
                    pa.array(dl).take(owner),
                ],
                names=["key", "chunk_idx", "tf", "dl"],
            )


def placed_postings(chunks: DataFrame, parts: int) -> DataFrame:
    """`postings` of chunks dealt to so many partitions by chunk.

    The texts are what is shuffled: they are smaller than their postings.
    """
    body, names = _body_and_names(enriched=True)
    rows = chunks.select("chunk_idx", body.alias("body"), names.alias("names"))
    return rows.repartition(parts, "chunk_idx").mapInArrow(_post, "key string, chunk_idx bigint, tf int, dl int")


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(term, df).  Partial counts keep a term of every chunk cheap to shuffle."""
    return (
        posted.where("tf > 0")
        .groupBy(F.col("key").alias("term"))
        .agg(F.count(F.lit(1)).alias("df"))
    )


def chunk_sizes(forward: DataFrame) -> DataFrame:
    """One row: n_docs and the sum of their lengths; chunks without a token count."""
    return forward.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(F.col("dl").cast("bigint")), F.lit(0)).alias("sum_dl"),
    )


def raw_idf(n_docs, df):
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def corpus_totals(sizes: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl, n_terms, mean_idf, idf_floor.

    The mean covers the whole vocabulary, terms with a negative idf included.
    """
    n_docs, sum_dl = sizes.select("n_docs").scalar(), sizes.select("sum_dl").scalar()
    return frequencies.agg(
        n_docs.alias("n_docs"),
        F.when(n_docs > 0, sum_dl / n_docs).otherwise(0.0).alias("avgdl"),
        F.count(F.lit(1)).alias("n_terms"),
        F.avg(raw_idf(n_docs, F.col("df"))).alias("mean_idf"),
    ).withColumn("idf_floor", F.lit(IDF_FLOOR_SHARE) * F.col("mean_idf"))


def totals_of(sizes: DataFrame, spread: DataFrame) -> DataFrame:
    """`corpus_totals` from sizes (one row) and spread(df, terms), how many terms have which frequency."""
    n_docs, sum_dl = sizes.select("n_docs").scalar(), sizes.select("sum_dl").scalar()
    n_terms = F.coalesce(F.sum("terms"), F.lit(0))
    return spread.agg(
        n_docs.alias("n_docs"),
        F.when(n_docs > 0, sum_dl / n_docs).otherwise(0.0).alias("avgdl"),
        n_terms.alias("n_terms"),
        F.when(n_terms > 0, F.sum(F.col("terms") * raw_idf(n_docs, F.col("df"))) / n_terms).alias("mean_idf"),
    ).withColumn("idf_floor", F.lit(IDF_FLOOR_SHARE) * F.col("mean_idf"))


@dataclass(frozen=True)
class KeywordIndex:
    """postings(key, chunk_idx, tf, dl), frequencies(term, df), totals (one row).

    `frequencies` may hold a term several times, once per generation; they add
    up.  `parts` are the tables of the postings, each placed by chunk.
    """

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame
    parts: tuple[DataFrame, ...] = ()

    @staticmethod
    def over(chunks: DataFrame, enriched: bool = True) -> KeywordIndex:
        """Index a chunk table on the fly, kept on the executors.

        Statistics and scoring both read it; a lost executor's part is computed
        again.  Corpora that are asked more than once belong in a store.
        """
        forward = forward_index(chunks, enriched).persist(StorageLevel.MEMORY_AND_DISK)
        posted = postings(forward)
        frequencies = document_frequencies(posted)
        return KeywordIndex(posted, frequencies, corpus_totals(chunk_sizes(forward), frequencies))


def question_keys(questions: DataFrame) -> DataFrame:
    """questions(qid, question) -> (qid, key, qtf, pos, searchable, named).

    Terms carry their multiplicity in the boosted question; names carry the
    position of the identifier.  A question without any token cannot search.
    """
    asked = questions.select(
        "qid",
        counted(tx.tokens(tx.boosted_question(F.col("question"))), "term", "tf").alias("terms"),
        tx.identifiers(F.col("question")).alias("names"),
    )
    as_terms = F.transform(
        "terms",
        lambda t: F.struct(
            t["term"].alias("key"),
            t["tf"].cast("double").alias("qtf"),
            F.lit(None).cast("int").alias("pos"),
        ),
    )
    as_names = F.transform(
        "names",
        lambda name, i: F.struct(
            F.concat(F.lit(NAME_MARK), F.lower(name)).alias("key"),
            F.lit(None).cast("double").alias("qtf"),
            i.alias("pos"),
        ),
    )
    return asked.select(
        "qid",
        (F.size("terms") > 0).alias("searchable"),
        (F.size("names") > 0).alias("named"),
        F.explode(F.concat(as_terms, as_names)).alias("k"),
    ).select("qid", "k.key", "k.qtf", "k.pos", "searchable", "named")


@dataclass(frozen=True)
class _Asked:
    """A batch of questions as arrays: question rows, and per key the questions that ask it.

    Keys are numbered by their place; `first` bounds the askers of each key.
    `dense` are the terms that so many questions and chunks share that they are
    bounded as a matrix.
    """

    qids: list
    searchable: np.ndarray
    named: np.ndarray
    keys: list[str]
    first: np.ndarray
    asker: np.ndarray
    weight: np.ndarray  # nan for a name
    pos: np.ndarray  # -1 for a term
    dense: np.ndarray
    avgdl: float

    def small(self) -> _Asked:
        """The same in less space."""
        return replace(self, first=self.first.astype(np.int32), asker=self.asker.astype(np.int32), pos=self.pos.astype(np.int32))


def _known(index: KeywordIndex, terms: DataFrame, names: pa.ChunkedArray) -> pa.Table:
    """(key, df) of the terms that the index holds, and of all names without a df, by key."""
    df = index.frequencies.join(terms, "term").groupBy(F.col("term").alias("key")).agg(F.sum("df").alias("df")).toArrow()
    names = pc.unique(names).cast(pa.string())
    marked = pa.table({"key": names, "df": pa.nulls(len(names), pa.int64())})
    schema = pa.schema([("key", pa.string()), ("df", pa.int64())])
    return pa.concat_tables([df.cast(schema), marked.cast(schema)]).sort_by("key").combine_chunks()


def _totals(index: KeywordIndex):
    return index.totals.select("n_docs", "avgdl", "idf_floor").first()


def _asked(keys: pa.Table | list, index: KeywordIndex, words: pa.Table | None = None, totals=None) -> _Asked:
    """A batch of question keys (a table, or rows), of bounded size, with their weights.

    Keys are numbered by their place in `words`, or among those of the batch.
    """
    spark = index.frequencies.sparkSession
    if not isinstance(keys, pa.Table):
        keys = pa.Table.from_pylist([row.asDict() for row in keys])
        for name, kind in (("qtf", pa.float64()), ("pos", pa.int32())):
            keys = keys.set_column(keys.column_names.index(name), name, keys[name].cast(kind))
    totals = totals or _totals(index)
    own = words is None
    if own:
        is_term = pc.is_null(keys["pos"])
        terms = spark.createDataFrame(pa.table({"term": pc.unique(keys["key"].filter(is_term)).cast(pa.string())}))
        words = _known(index, F.broadcast(terms), keys["key"].filter(pc.invert(is_term)))
    # Unknown terms match no chunk.
    number = pc.index_in(keys["key"], value_set=words["key"].combine_chunks())
    keys = keys.append_column("number", number).filter(pc.is_valid(number)).sort_by([("number", "ascending"), ("qid", "ascending")])

    def column(name: str, none=None) -> np.ndarray:
        return (keys[name] if none is None else pc.fill_null(keys[name], none)).to_numpy()

    pos, number = column("pos", -1).astype(np.int64), column("number")
    df = pc.fill_null(words["df"], 0).to_numpy().astype(np.float64)
    found = df[number]
    with np.errstate(invalid="ignore", divide="ignore"):
        idf = np.log(totals["n_docs"] - found + 0.5) - np.log(found + 0.5)
    floor = np.nan if totals["idf_floor"] is None else totals["idf_floor"]
    weight = np.where(pos < 0, column("qtf", 0.0) * np.where(idf < 0, floor, idf), np.nan)
    numbered = keys["qid"].combine_chunks().dictionary_encode()
    qids, asker = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64)
    searchable, named = np.zeros(len(qids), bool), np.zeros(len(qids), bool)
    searchable[asker], named[asker] = column("searchable"), column("named")
    first = np.searchsorted(number, np.arange(len(words) + 1))
    shared = np.diff(first) * df
    by_share = np.argsort(-shared, kind="stable")[: DENSE_CELLS // max(1, len(qids))]
    dense = by_share[shared[by_share] * DENSE_GAIN > len(qids) * totals["n_docs"]]
    return _Asked(qids, searchable, named, words["key"].to_pylist() if own else [], first, asker, weight, pos, dense, totals["avgdl"])


class _Lists:
    """The k first chunks of every question so far; smaller values come first, then smaller ids."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.last = np.full(questions, np.inf)
        self.held = np.zeros(questions, np.int64)
        # value, chunk, score, position of the name
        self.lists = tuple(np.zeros((questions, k), t) for t in (np.float64, np.int64, np.float64, np.float32))

    def offer(self, q: np.ndarray, value: np.ndarray, chunk: np.ndarray, score: np.ndarray, pos: np.ndarray) -> None:
        near = value <= self.last[q]
        if not near.any():
            return
        # Only lists that something may enter are sorted anew.
        touched = np.unique(q[near])
        full = np.arange(self.k) < self.held[touched, None]
        own = np.concatenate((np.nonzero(full)[0], np.searchsorted(touched, q[near])))
        rows = [np.concatenate((old[touched][full], new[near])) for old, new in zip(self.lists, (value, chunk, score, pos))]
        order = np.lexsort((rows[1], rows[0], own))
        own = own[order]
        count = np.bincount(own, minlength=len(touched))
        place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        kept = place < self.k
        for old, new in zip(self.lists, rows):
            old[touched[own[kept]], place[kept]] = new[order][kept]
        self.held[touched] = np.minimum(count, self.k)
        filled = touched[self.held[touched] == self.k]
        self.last[filled] = self.lists[0][filled, self.k - 1]

    @property
    def rows(self) -> tuple[np.ndarray, ...]:
        """Question, value, chunk, score and position of every entry."""
        full = np.arange(self.k) < self.held[:, None]
        return np.nonzero(full)[0], *(c[full] for c in self.lists)


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of lists that start at `first` and have `count` entries, one list after the other."""
    ends = np.cumsum(count)
    places = np.repeat(first - ends + count, count)
    places += np.arange(len(places))
    return places


def _portions(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices that have so many in all at most; a larger one is alone."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        before = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(at, until)
        at = until


def _places(found: np.ndarray) -> np.ndarray:
    """`flatnonzero` of an array that is False nearly everywhere, eight places at a time."""
    flat = found.reshape(-1)
    words = len(flat) >> 3
    own = np.flatnonzero(flat[: words << 3].view(np.uint64) != 0)
    row, place = np.nonzero(flat[: words << 3].reshape(words, 8)[own])
    return np.concatenate((own[row] * 8 + place, np.flatnonzero(flat[words << 3 :]) + (words << 3)))


def _by_small(numbers: np.ndarray) -> np.ndarray:
    """A stable order; small numbers are sorted by their digits."""
    small = len(numbers) == 0 or numbers.max() < 1 << 16
    return np.argsort(numbers.astype(np.uint16) if small else numbers, kind="stable")


@dataclass(frozen=True)
class _Labels:
    """Kinds of questions by the terms that many questions and chunks share: `centres` has a column per label.

    Questions and chunks of a kind are kept together, so that blocks of other
    kinds have few terms in common.  Labels decide the order of work alone.
    """

    terms: np.ndarray
    centres: np.ndarray

    @staticmethod
    def of(asked: _Asked) -> _Labels | None:
        terms, questions = asked.dense[:LABEL_TERMS], len(asked.qids)
        if questions <= GROUP_QUESTIONS or len(terms) < LABELS:
            return None
        offers = np.zeros((questions, len(terms)), np.float32)
        for at, term in enumerate(terms):
            use = slice(asked.first[term], asked.first[term + 1])
            np.add.at(offers[:, at], asked.asker[use], np.maximum(asked.weight[use], 0))
        offers = offers[offers.any(axis=1)]
        offers = offers[:: -(-len(offers) // LABEL_SAMPLE)] if len(offers) else offers
        if len(offers) < LABELS:
            return None
        offers /= np.linalg.norm(offers, axis=1, keepdims=True)
        centres = offers[:: len(offers) // LABELS][:LABELS].T.copy()
        for _ in range(LABEL_ROUNDS):
            label = np.argmax(offers @ centres, axis=1)
            for own in range(LABELS):
                if (label == own).any():
                    centres[:, own] = offers[label == own].sum(axis=0)
            centres /= np.linalg.norm(centres, axis=0)
        # Like labels follow each other.
        chain, alike = [0], centres.T @ centres
        while len(chain) < LABELS:
            alike[:, chain[-1]] = -1
            chain.append(int(np.argmax(alike[chain[-1]])))
        return _Labels(terms, centres[:, chain])

    def label(self, rows: int, row: np.ndarray, key: np.ndarray, value: np.ndarray, n_keys: int) -> np.ndarray:
        column = np.full(n_keys, -1)
        column[self.terms] = np.arange(len(self.terms))
        own = np.flatnonzero(column[key] >= 0)
        offers = np.zeros((rows, len(self.terms)), np.float32)
        offers[row[own], column[key[own]]] = value[own]
        return np.argmax(offers @ self.centres, axis=1)


def _sorted_by_label(asked: _Asked, labels: _Labels | None) -> _Asked:
    """The same questions, those of a kind together."""
    if labels is None:
        return asked
    key = np.repeat(np.arange(len(asked.first) - 1), np.diff(asked.first))
    term = asked.pos < 0
    label = labels.label(len(asked.qids), asked.asker[term], key[term], np.maximum(asked.weight[term], 0), len(asked.first) - 1)
    order = _by_small(label)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return replace(
        asked, qids=[asked.qids[i] for i in order], searchable=asked.searchable[order], named=asked.named[order], asker=place[asked.asker]
    )


class _Block:
    """Postings of some chunks by key: the chunks that hold it, and the most it can add."""

    def __init__(self, chunk: np.ndarray, row: np.ndarray, key: np.ndarray, saturated: np.ndarray, n_keys: int):
        self.chunk = chunk
        code = key * len(chunk) + row
        order = np.argsort(code)
        if (np.diff(code[order]) == 0).any():
            # Of a posting that comes twice the first counts.
            order = np.argsort(code, kind="stable")
            order = order[np.diff(code[order], prepend=-1) > 0]
        key, row, saturated = key[order], row[order], saturated[order]
        self.row, self.single = row.astype(np.int32), saturated.astype(np.float32)
        # The same by chunk, for scores.
        by_row = _by_small(row)
        self.code, self.saturated = (row * n_keys + key)[by_row], saturated[by_row]
        self.first = np.flatnonzero(np.diff(key, prepend=-1))
        self.count = np.diff(self.first, append=len(key))
        self.most = np.maximum.reduceat(self.single, self.first) if len(key) else self.single
        # Absent keys have the last place: no chunk, and nothing to add.
        self.place = np.full(n_keys, len(self.first), np.int32)
        self.place[key[self.first]] = np.arange(len(self.first))
        self.first, self.count, self.most = (np.append(x, x.dtype.type(0)) for x in (self.first, self.count, self.most))


def _block_rows(questions: int) -> int:
    """Chunks whose bounds for a group of questions are held at once."""
    return max(1, BLOCK_CELLS // max(1, min(questions, GROUP_QUESTIONS)))


def _slabs(batches: Iterator[pa.RecordBatch], rows: int, n_keys: int, avgdl: float, labels: _Labels | None) -> Iterator[list[_Block]]:
    """Chunks (chunk_idx, dl, terms) in blocks of at most so many rows, a bounded number of postings at a time."""
    held, size = [], 0
    for batch in batches:
        ends, at = batch.column(2).offsets.to_numpy(), 0
        while at < batch.num_rows:
            until = int(np.searchsorted(ends, ends[at] + SLAB_POSTINGS - size, side="right")) - 1
            until = max(until, at + (not held))
            if until > at:
                held.append(batch.slice(at, until - at))
                size += int(ends[until] - ends[at])
            if until < batch.num_rows:
                blocks, held, size = _blocks(held, rows, n_keys, avgdl, labels), [], 0
                yield blocks
                del blocks
            at = until
        del batch
    if held:
        blocks, held = _blocks(held, rows, n_keys, avgdl, labels), []
        yield blocks


def _blocks(held: list[pa.RecordBatch], rows: int, n_keys: int, avgdl: float, labels: _Labels | None) -> list[_Block]:
    chunk, dl = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
    count = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held]).astype(np.int64)
    parts = [b.column(2).flatten() for b in held]
    key, tf = (np.concatenate([p.field(name).to_numpy() for p in parts]) for name in ("number", "tf"))
    held.clear()
    del parts
    owner = np.repeat(np.arange(len(chunk)), count)
    saturated = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[owner] / avgdl))
    kind = np.zeros(len(chunk), np.int64) if labels is None else labels.label(len(chunk), owner, key, saturated, n_keys)
    del owner, tf
    order, first = np.lexsort((dl, kind)), np.cumsum(count) - count
    blocks = []
    for part in _portions(count[order], BLOCK_POSTINGS):
        for at in range(part.start, part.stop, rows):
            own = order[at : min(at + rows, part.stop)]
            place = _expand(first[own], count[own])
            row = np.repeat(np.arange(len(own)), count[own])
            blocks.append(_Block(chunk[own], row, key[place].astype(np.int64), saturated[place], n_keys))
    return blocks


class _Group:
    """Some questions of a batch: their uses of terms and names, by key."""

    def __init__(self, begin: int, end: int, term: tuple[np.ndarray, ...], name: tuple[np.ndarray, ...]):
        self.begin, self.size = begin, end - begin
        key, self.asker, self.gain = term
        self.keys, self.key, self.asks = np.unique(key, return_inverse=True, return_counts=True)
        self.names = name


class BlockWalk:
    """Exact top lists of a task by bounds.

    Chunks come in blocks and questions in groups, so that a bounded number of
    cells (chunk, question) is met at once.  What a block can offer a question at
    most decides whether the question meets it.  What every chunk of the block can
    offer the others is bounded in single precision: by a product of matrices over
    the terms that many of these chunks and questions share, and by the postings
    of all other terms.  Chunks of large bounds fill the lists; a cell below the
    last score of a full list is skipped, and only the others are scored, term by
    term in double precision.  `cells` counts cells with a bound of their own,
    `scored` those with a score.
    """

    def __init__(self, asked: _Asked, k: int, inject: bool, best: bool, lists: tuple[_Lists, _Lists | None] | None = None):
        self.asked, self.inject = asked, inject
        self.questions, self.n_keys = len(asked.qids), len(asked.first) - 1
        self.lists, self.top = lists or (_Lists(self.questions, k), _Lists(self.questions, 1) if best else None)
        self.seeds = k + 1
        self.buffer = np.empty(0, np.float32)
        self.cells = self.scored = 0
        key = np.repeat(np.arange(self.n_keys), np.diff(asked.first))
        term = asked.pos < 0
        asker = asked.asker[term]
        by_question = _by_small(asker)
        self.key, self.weight = key[term][by_question], asked.weight[term][by_question]
        self.begin = np.searchsorted(asker[by_question], np.arange(self.questions + 1))
        self.tight = not (self.weight < 0).any()
        # Every sum of a question's terms may be short by as many roundings.
        self.share = 1 - (np.diff(self.begin) + 4) * np.finfo(np.float32).eps
        size = max(1, min(self.questions, GROUP_QUESTIONS, BLOCK_CELLS))
        begins = np.arange(0, self.questions, size)
        parts = []
        for own, value in ((term, np.maximum(asked.weight[term], 0).astype(np.float32)), (~term, asked.pos[~term].astype(np.float64))):
            group = asked.asker[own] // size
            order = _by_small(group)
            at = np.searchsorted(group[order], np.arange(len(begins) + 1))
            columns = key[own][order], (asked.asker[own] - group * size)[order], value[order]
            parts.append([tuple(c[at[i] : at[i + 1]] for c in columns) for i in range(len(begins))])
        self.groups = [_Group(b, min(b + size, self.questions), *uses) for b, *uses in zip(begins, *parts)]

    def add(self, batch: pa.RecordBatch) -> None:
        for blocks in _slabs(iter([batch]), _block_rows(self.questions), self.n_keys, self.asked.avgdl, None):
            self.walk(blocks)

    def walk(self, blocks: list[_Block]) -> None:
        for block in blocks:
            for group in self.groups:
                self._meet(block, group)

    def _least(self, q: slice | np.ndarray) -> np.ndarray:
        """What a chunk must be able to offer questions; more than nothing in any case."""
        least = -self.lists.last[q]
        if self.top is not None:
            least = np.where(self.asked.named[q], np.minimum(least, -self.top.last[q]), least)
        return np.maximum((least - SLACK) * self.share[q], np.finfo(np.float32).tiny).astype(np.float32)

    def _meet(self, block: _Block, group: _Group) -> None:
        own = slice(group.begin, group.begin + group.size)
        key, asker, gain = group.key, group.asker, group.gain
        place = block.place[group.keys]
        offer = np.bincount(asker, gain * block.most[place][key], group.size)
        positions = self._positions(block, group)
        met = offer * (1 + SLACK) >= self._least(own)
        met[positions[0] % group.size] = True
        q = np.flatnonzero(met)
        if not len(q):
            return
        asks = group.asks
        if len(q) < group.size:
            column = np.cumsum(met) - 1
            use = np.flatnonzero(met[asker])
            key, asker, gain = key[use], column[asker[use]], gain[use]
            asks = np.bincount(key, minlength=len(asks))
            row, at = np.divmod(positions[0], group.size)
            positions = row * len(q) + column[at], positions[1]
        bound = self._bounds(block, place, key, asker, gain, asks, len(q))
        q += group.begin
        self.cells += bound.size
        todo = np.unique(positions[0])
        self._score(block, q, todo, positions)
        near = bound >= self._least(q)
        if np.count_nonzero(near) > CROWDED * self.seeds * len(q):
            # Chunks of the largest bounds raise what the others must reach.
            crowded = np.flatnonzero(np.count_nonzero(near, axis=0) > self.seeds)
            for at in range(0, len(crowded), SEED_COLUMNS):
                columns = crowded[at : at + SEED_COLUMNS]
                mine = np.ascontiguousarray(bound[:, columns].T)
                best = np.argpartition(mine, -self.seeds, axis=1)[:, -self.seeds :]
                hopeful = np.take_along_axis(mine, best, axis=1) > 0
                seeds = np.setdiff1d((best * len(q) + columns[:, None])[hopeful], todo)
                self._score(block, q, seeds, positions)
                todo = np.union1d(todo, seeds)
            near = bound >= self._least(q)
        left = self._first(_places(near), bound, q)
        self._score(block, q, np.setdiff1d(left, todo, assume_unique=True), positions)

    def _first(self, cells: np.ndarray, bound: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Cells without those that enough others of the same question and block are sure to beat."""
        if not self.tight:
            return cells
        value, column = bound.reshape(-1)[cells], cells % len(q)
        order = np.lexsort((-value, column))
        count = np.bincount(column, minlength=len(q))
        full = np.flatnonzero(count >= self.lists.k)
        last = np.full(len(q), -np.inf)
        # A bound is short of the score, or beyond it, by roundings alone.
        last[full] = value[order[(np.cumsum(count) - count)[full] + self.lists.k - 1]] * self.share[q[full]] ** 2 - SLACK
        return cells[value >= last[column]]

    def _bounds(self, block: _Block, place: np.ndarray, key: np.ndarray, asker: np.ndarray, gain: np.ndarray, asks: np.ndarray, questions: int) -> np.ndarray:
        """What each chunk can offer each question; uses name their key by its place in the group."""
        chunks, held = len(block.chunk), block.count[place]
        if len(self.buffer) < chunks * questions:
            self.buffer = np.empty(chunks * questions, np.float32)
        shared = held * asks
        dense = np.flatnonzero(shared * DENSE_GAIN > chunks * questions)
        most = DENSE_CELLS // (chunks + questions)
        if len(dense) > most:
            dense = np.sort(dense[np.argsort(-shared[dense], kind="stable")[:most]])
        column = np.full(len(asks), -1)
        column[dense] = np.arange(len(dense))
        at = column[key]
        common = np.flatnonzero(at >= 0)
        asked = np.zeros((len(dense), questions), np.float32)
        np.add.at(asked.reshape(-1), at[common] * questions + asker[common], gain[common])
        own = _expand(block.first[place[dense]], held[dense])
        offered = np.zeros((len(dense), chunks), np.float32)
        offered[np.repeat(np.arange(len(dense)), held[dense]), block.row[own]] = block.single[own]
        bound = np.matmul(offered.T, asked, out=self.buffer[: chunks * questions].reshape(chunks, questions))
        flat = self.buffer[: chunks * questions]
        rare = np.flatnonzero((at < 0) & (held > 0)[key])
        count, first = held[key[rare]], block.first[place[key[rare]]]
        for part in _portions(count, BLOCK_USES):
            use, many = rare[part], count[part]
            own = _expand(first[part], many)
            cell = block.row[own] * np.int64(questions)
            cell += np.repeat(asker[use], many)
            np.add.at(flat, cell, np.repeat(gain[use], many) * block.single[own])
        return bound

    def _positions(self, block: _Block, group: _Group) -> tuple[np.ndarray, np.ndarray]:
        """Cells of chunks that questions name, ascending, and the position of the name."""
        key, asker, position = group.names
        place = block.place[key]
        count = block.count[place]
        own = _expand(block.first[place], count)
        cell = block.row[own] * np.int64(group.size) + np.repeat(asker, count)
        order = np.argsort(cell, kind="stable")
        return cell[order], np.repeat(position, count)[order]

    def _parts(self, todo: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
        """Cells a bounded number at a time, with a bounded number of terms."""
        for at in range(0, len(todo), SCORED_CELLS):
            own = todo[at : at + SCORED_CELLS]
            asker = q[own % len(q)]
            for part in _portions(self.begin[asker + 1] - self.begin[asker], SCORED_TERMS):
                yield own[part]

    def _score(self, block: _Block, questions: np.ndarray, todo: np.ndarray, positions: tuple[np.ndarray, np.ndarray]) -> None:
        """Score cells (chunk * questions + question, ascending), a bounded number at a time."""
        self.scored += len(todo)
        places, position = positions
        for own in self._parts(todo, questions):
            row, q = own // len(questions), questions[own % len(questions)]
            count = self.begin[q + 1] - self.begin[q]
            term, cell = _expand(self.begin[q], count), np.repeat(np.arange(len(own)), count)
            key = self.key[term]
            here = np.flatnonzero(block.count[block.place[key]])
            term, cell = term[here], cell[here]
            wanted = row[cell] * self.n_keys + key[here]
            place = np.minimum(np.searchsorted(block.code, wanted), max(len(block.code) - 1, 0))
            hit = block.code[place] == wanted
            score = np.bincount(cell[hit], self.weight[term[hit]] * block.saturated[place[hit]], len(own))
            pos = np.full(len(own), np.inf)
            known = np.searchsorted(own, places)
            mine = known < len(own)
            mine[mine] &= own[known[mine]] == places[mine]
            np.minimum.at(pos, known[mine], position[mine])
            by_score = -np.round(score, SCORE_DIGITS)
            is_named = np.isfinite(pos)
            value = np.where(is_named, pos - NAMED_FIRST, by_score) if self.inject else by_score
            chunk = block.chunk[row]
            kept = (score > 0) | (is_named & self.inject)
            self.lists.offer(q[kept], value[kept], chunk[kept], score[kept], pos[kept])
            if self.top is not None:
                kept = self.asked.named[q] & ((score > 0) | is_named)
                self.top.offer(q[kept], by_score[kept], chunk[kept], score[kept], pos[kept])


def _shipped(asked: _Asked | Broadcast) -> _Asked:
    """A batch of questions; one that was broadcast is read from its file each time, and not kept."""
    if not isinstance(asked, Broadcast):
        return asked
    path = getattr(asked, "_path", None)
    return asked.value if path is None else asked.load_from_path(path)


def _listing(batches_asked: list[_Asked | Broadcast], rows: int, labels: _Labels | None, k: int, inject: bool, best: bool):
    """Score the chunks of a task, a bounded number at a time, and hand on its first k per question."""

    def walk_of(n: int, lists: tuple[_Lists, _Lists | None] | None) -> BlockWalk:
        return BlockWalk(_shipped(batches_asked[n]), k, inject, best, lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, lists = walk_of(0, None), {}
        for blocks in _slabs(batches, rows, walk.n_keys, walk.asked.avgdl, labels):
            for n in range(len(batches_asked)):
                # One batch of questions at a time is held, and the lists of all.
                if len(batches_asked) > 1:
                    buffer = walk.buffer
                    del walk
                    walk = walk_of(n, lists.get(n))
                    walk.buffer = buffer
                walk.walk(blocks)
                lists[n] = walk.lists, walk.top
            del blocks
        for n, found in lists.items():
            asked = walk.asked if len(batches_asked) == 1 else _shipped(batches_asked[n])
            qids = np.asarray(asked.qids, dtype=object)
            for label, own in zip(("leg", "best"), found):
                if own is not None and own.held.any():
                    q, _, chunk, score, pos = own.rows
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(qids[q]), pa.array([label] * len(q)), pa.array(chunk), pa.array(score),
                            pa.array(np.where(np.isfinite(pos), pos, -1).astype(np.int32), mask=~np.isfinite(pos)),
                            pa.array(asked.searchable[q]), pa.array(asked.named[q]),
                        ],
                        names=["qid", "list", "chunk_idx", "score", "pos", "searchable", "named"],
                    )

    return run


def _passes(questions: DataFrame, index: KeywordIndex, listed: int) -> Iterator[tuple[pa.ChunkedArray, int, Iterator[_Asked]]]:
    """All questions in batches of bounded size, how many, and the keys that number theirs: a pass over the index each.

    A pass takes as many batches as a task can hold lists of, `listed` entries per question.
    """
    keys = question_keys(questions)
    # One bounded read both fetches a small set of questions and finds out that it is small.
    few = keys.limit(QUESTION_KEYS + 1).toArrow()
    totals = _totals(index)
    if len(few) <= QUESTION_KEYS:
        asked = _asked(few, index, totals=totals)
        yield pa.array(asked.keys, pa.string()), 1, iter([asked])
        return
    seen = checkpointed(keys)
    batches = -(-seen.count() // QUESTION_KEYS) + 1
    words = seen.select("key").distinct().count()
    entries = questions.count() * listed
    passes = max(-(-batches // PASS_BATCHES), -(-entries // PASS_ENTRIES), -(-words // PASS_WORDS))
    batches = -(-batches // passes) * passes
    number = F.pmod(F.xxhash64("qid"), F.lit(batches))
    for at in range(passes):
        own = seen.where(number % passes == at)
        names = own.where("pos IS NOT NULL").select("key").distinct().toArrow()["key"]
        known = _known(index, own.where("pos IS NULL").select(F.col("key").alias("term")).distinct(), names)
        parts = (seen.where(number == batch).toArrow() for batch in range(at, batches, passes))
        yield known["key"], batches // passes, (_asked(part, index, known, totals) for part in parts if len(part))


def listed_matches(questions: DataFrame, index: KeywordIndex, k: int, inject: bool, best: bool = False) -> DataFrame:
    """The first k chunks of every question in every task of the index.

    -> (qid, list, chunk_idx, score, pos, searchable, named).  `inject` puts the
    chunks that a question names first; pos is null for others.  The list
    `best` has the best score of questions with names.

    Questions travel to the postings in batches of bounded size, many to a pass
    over the index: postings are never shuffled.
    """
    spark = questions.sparkSession
    schema = f"qid {questions.schema['qid'].dataType.simpleString()}, list string, chunk_idx bigint, score double, pos int, searchable boolean, named boolean"
    found = []
    for keys, many, batches in _passes(questions, index, k + best):
        numbers = spark.createDataFrame(pa.table({"number": pa.array(range(len(keys)), pa.int32()), "key": keys}))
        asked, labels, rows = [], None, 1
        for own in batches:
            if not asked:
                labels, rows = _Labels.of(own), _block_rows(len(own.qids))
            own = replace(_sorted_by_label(own, labels), keys=[])  # known by their numbers
            asked.append(own if many == 1 else spark.sparkContext.broadcast(own.small()))
        if not asked:
            continue
        for posted in index.parts or (index.postings,):
            if 0 < len(keys) <= LISTED_KEYS:
                # The stored postings are sorted by key: the scan skips row groups without these.
                posted = posted.where(F.col("key").isin(keys.to_pylist()))
            terms = (
                posted.join(F.broadcast(numbers), "key")
                .groupBy("chunk_idx")
                .agg(F.first("dl").alias("dl"), F.collect_list(F.struct("number", "tf")).alias("terms"))
            )
            lists = terms.select("chunk_idx", "dl", "terms").mapInArrow(_listing(asked, rows, labels, k, inject, best), schema)
            found.append(lists if many == 1 else checkpointed(lists))
        for own in asked:
            if many > 1:
                own.destroy()
    return stack(*found)


def _spread(index: KeywordIndex) -> str | None:
    return "chunk_idx" if many_tasks(index.postings) else None


def bm25_scores(questions: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """Plain BM25 top-k without symbol injection: (qid, rank, chunk_idx, score)."""
    hits = listed_matches(questions, index, k, inject=False).where("searchable")
    order = [F.round("score", SCORE_DIGITS).desc(), F.col("chunk_idx")]
    return top_ranked(hits, ["qid"], order, k, spread_by=_spread(index)).select("qid", "rank", "chunk_idx", "score")


def keyword_leg(questions: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """Top-k with symbol injection: chunks named in the question come first.

    -> (qid, rank, chunk_idx, score, injected, searchable).
    """
    hits = listed_matches(questions, index, k, inject=True)
    order = [
        F.col("pos").asc_nulls_last(),
        F.when(F.col("pos").isNull(), -F.round("score", SCORE_DIGITS)).asc(),
        F.col("chunk_idx"),
    ]
    return top_ranked(hits, ["qid"], order, k, spread_by=_spread(index)).select(
        "qid", "rank", "chunk_idx", "score", F.col("pos").isNotNull().alias("injected"), "searchable"
    )


def keyword_search(questions: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """The `bm25` method: injected chunks score 100 above the question's best score.

    The best score may belong to a chunk outside the list, so questions with
    names list their best match by score alone, in the same pass.
    """
    listed = listed_matches(questions, index, k, inject=True, best=True).where("searchable")
    pos = F.when(F.col("list") == "leg", F.col("pos"))
    order = [
        pos.asc_nulls_last(),
        F.when(pos.isNull(), -F.round("score", SCORE_DIGITS)).asc(),
        F.col("chunk_idx"),
    ]
    ranked = top_ranked(listed, ["qid", "list"], order, k, spread_by=_spread(index))
    top = F.max(F.when((F.col("list") == "best") & (F.col("rank") == 0), F.col("score"))).over(Window.partitionBy("qid"))
    best = F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)
    injected = F.col("pos").isNotNull()
    return (
        ranked.withColumn("best", top)
        .where("list = 'leg'")
        .select(
            "qid", "rank", "chunk_idx",
            F.when(injected, best + INJECTED_BONUS).otherwise(F.col("score")).alias("score"),
            injected.alias("injected"),
        )
    )


def symbol_table(chunks: DataFrame) -> DataFrame:
    """(key, chunk_idx): each lower-case name a chunk answers to."""
    return chunks.select(F.explode(tx.symbol_keys(F.col("symbol"))).alias("key"), "chunk_idx")


def symbol_matches(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks named in each question, in the order they are injected.

    -> (qid, chunk_idx, pos); order by (pos, chunk_idx).
    """
    names = questions.select("qid", F.posexplode(tx.identifiers(F.col("question"))).alias("pos", "name"))
    keys = names.select("qid", "pos", F.lower("name").alias("key"))
    matched = join_lookup(symbol_table(chunks), keys, "key", "chunk_idx", fits_broadcast(keys))
    return matched.groupBy("qid", "chunk_idx").agg(F.min("pos").alias("pos"))
