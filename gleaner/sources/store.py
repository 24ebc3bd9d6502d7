"""The stored corpus: chunks, vectors and the keyword index as Parquet tables.

Every ingest writes a new generation next to the old ones: chunks, their ids,
vectors, postings, and only its own counts of the statistics.  One commit row at
the end makes all of it visible; a job that dies before leaves nothing that a
reader sees, and running it again stores everything.  Nothing is rewritten in
place.

`compact` merges generations of a level into one of the next, so that a row is
rewritten once per level and a store of n ingests has about log n generations;
then it folds the commits into a snapshot.  `vacuum` deletes what was replaced.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import keyword
from gleaner.operators.batching import batched_embeddings
from gleaner.operators.chunking import keep_first
from gleaner.operators.joins import estimated_bytes, stack
from gleaner.operators.keyword import KeywordIndex
from gleaner.operators.vector_index import VectorIndex, centroids
from gleaner.plans.retrieve import BLOCK_ROW_BITS, META, Corpus, block_of
from gleaner.providers import OFFLINE, Providers

CHUNK_SCHEMA = (
    "chunk_idx bigint, chunk_id string, text string, source_path string, kind string, symbol string, "
    "start_line int, end_line int, block bigint"
)
COMMIT_SCHEMA = (
    "seq bigint, gen bigint, what string, n_rows bigint, shards int, next_block bigint, level int, replaces array<bigint>"
)
# What a commit stands for: chunks with or without postings, postings of everything so far,
# and generations that took the place of others.
RESET, CHUNKS, INDEXED, REBUILT = "reset", "chunks", "indexed", "rebuilt"
MERGED_CHUNKS, MERGED_POSTINGS, POSTINGS, CELLS = "merged-chunks", "merged-postings", "postings", "cells"
# Generations of a level that are merged into one.
FANOUT = 8
# Fewer new rows than this are looked up in the stored ids one by one.
LISTED_BYTES = 64 << 20
# Text that one shard of the keyword index is meant for.  A bucketed table has
# 100,000 buckets at most by default.
SHARD_BYTES = 2 << 30
LEAST_SHARDS, MOST_SHARDS = 8, 65_536
TOKEN_BYTES = 8
# Text that one task indexes.  A shard is written by as many tasks as it has of these.
PIECE_BYTES = 16 << 20


def sized_shards(text_bytes: int) -> int:
    """Shards for so much text; later ingests add to the same shards."""
    return int(min(max(text_bytes // SHARD_BYTES, LEAST_SHARDS), MOST_SHARDS))


def pieces(shards: int, text_bytes: int) -> int:
    """Partitions that write so much text: a multiple of the shards, so that a piece belongs to one shard.

    A multiple of n deals a hash to the same remainder by n.
    """
    return shards * max(1, -(-text_bytes // (PIECE_BYTES * shards)))


def keyword_tables(spark: SparkSession, root: str, shards: int) -> str:
    """Name of the bucketed postings table over `root`, known to this session's catalog.

    Name and folder hold the number of shards: files are never read by another one.
    """
    folder = f"{root}/postings-{shards}"
    name = "postings_" + hashlib.md5(folder.encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        spark.sql(
            f"CREATE TABLE {name} (key STRING, chunk_idx BIGINT, tf INT, dl INT, gen BIGINT) USING parquet "
            f"PARTITIONED BY (gen) CLUSTERED BY (chunk_idx) SORTED BY (key) INTO {shards} BUCKETS "
            f"LOCATION '{folder}'"
        )
    return name


def write_keywords(chunks: DataFrame, root: str, gen: int, shards: int, text_bytes: int, before: Sequence[int] = ()) -> None:
    """Index chunks into generation `gen`: sorted files of each shard, and what they add to the statistics.

    The postings of a chunk share a shard and each file is sorted by key, so a
    search reads the row groups of its own terms and needs no shuffle to score.
    A file is one task's piece of a shard: shards are few, and tasks must not
    grow with them.  `before` are the generations that the index is made of already.
    """
    spark = chunks.sparkSession
    _write_postings(keyword.placed_postings(chunks, pieces(shards, text_bytes)), root, gen, shards)
    added = spark.table(keyword_tables(spark, root, shards)).where(F.col("gen") == gen)
    # Chunks without a token count, too.
    n_docs, sum_dl = F.lit(chunks.count()).cast("bigint"), F.coalesce(F.sum(F.col("tf").cast("bigint")), F.lit(0))
    added.agg(n_docs.alias("n_docs"), sum_dl.alias("sum_dl")).write.mode("overwrite").parquet(f"{root}/sizes/gen={gen}")
    _write_terms(keyword.document_frequencies(added), root, gen)
    # How many terms have which frequency: those of the new terms change, all others stay.
    own = spark.read.parquet(f"{root}/vocabulary/gen={gen}")
    spread = own.groupBy("df").agg(F.count("*").alias("terms"))
    if before:
        old = _vocabulary(spark, root, before).join(own.select("term", F.col("df").alias("new")), "term")
        moved = old.groupBy("term").agg(F.sum("df").alias("df"), F.first("new").alias("new"))
        step = lambda df, terms: F.struct(df.alias("df"), F.lit(terms).alias("terms"))
        steps = F.array(step(F.col("df"), -1), step(F.col("new"), -1), step(F.col("df") + F.col("new"), 1))
        change = moved.select(F.explode(steps).alias("s")).select("s.df", F.col("s.terms").cast("bigint").alias("terms"))
        parts = [spread, change, spark.read.parquet(f"{root}/frequencies/gen={before[-1]}")]
        spread = stack(*parts).groupBy("df").agg(F.sum("terms").alias("terms")).where("terms <> 0")
    spread.coalesce(1).write.mode("overwrite").parquet(f"{root}/frequencies/gen={gen}")


def _write_postings(posted: DataFrame, root: str, gen: int, shards: int) -> None:
    name = keyword_tables(posted.sparkSession, root, shards)
    (
        posted.select("key", "chunk_idx", "tf", "dl", F.lit(gen).alias("gen"))
        .write.mode("append").partitionBy("gen").bucketBy(shards, "chunk_idx").sortBy("key")
        .format("parquet").saveAsTable(name)
    )


def _write_terms(frequencies: DataFrame, root: str, gen: int) -> None:
    frequencies.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/vocabulary/gen={gen}")


def _vocabulary(spark: SparkSession, root: str, gens: Sequence[int]) -> DataFrame:
    return spark.read.parquet(*[f"{root}/vocabulary/gen={g}" for g in gens])


def read_keywords(spark: SparkSession, root: str, gens: Sequence[int], shards: int | Sequence[int]) -> KeywordIndex:
    """The index made of the given generations, each with its own number of shards."""
    numbers = [shards] * len(gens) if isinstance(shards, int) else list(shards)
    parts = []
    for number in sorted(set(numbers)):
        name = keyword_tables(spark, root, number)
        spark.catalog.recoverPartitions(name)
        own = [g for g, n in zip(gens, numbers) if n == number]
        parts.append(spark.table(name).where(F.col("gen").isin(own)).drop("gen"))
    sizes = spark.read.parquet(*[f"{root}/sizes/gen={g}" for g in gens]).agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
    spread = spark.read.parquet(f"{root}/frequencies/gen={gens[-1]}")
    return KeywordIndex(stack(*parts), _vocabulary(spark, root, gens), keyword.totals_of(sizes, spread), tuple(parts))


@dataclass
class _State:
    """What the commits since the last reset add up to."""

    seq: int = -1
    epoch: int = 0
    next_block: int = 0
    chunks: dict[int, object] = field(default_factory=dict)
    postings: dict[int, object] = field(default_factory=dict)
    cells: int | None = None
    shards: int | None = None

    def take(self, row) -> None:
        what, gen = row["what"], row["gen"]
        if what == RESET:
            self.__init__(row["seq"], self.epoch)
            return
        self.seq = max(self.seq, row["seq"])
        self.next_block = max(self.next_block, row["next_block"] or 0)
        self.shards = self.shards or row["shards"]
        for merged, live in ((MERGED_CHUNKS, self.chunks), (MERGED_POSTINGS, self.postings)):
            if what == merged:
                for old in row["replaces"]:
                    live.pop(old)
                live[gen] = row
        if what in (CHUNKS, INDEXED):
            self.chunks[gen] = row
        if what == REBUILT:
            self.postings.clear()
        if what in (INDEXED, REBUILT, POSTINGS):
            self.postings[gen] = row
        if what == CELLS:
            self.cells = gen


@dataclass(frozen=True)
class Store:
    """A corpus under one folder.

    Each generation has as many index shards as its text asks for, unless a
    number is given: then it is kept with the corpus, and opening the store with
    another number is an error.
    """

    spark: SparkSession
    root: str
    shards: int | None = None

    # -- commits ---------------------------------------------------------------------

    def _log(self, epoch: int) -> str:
        return f"{self.root}/log/epoch={epoch}" if epoch else f"{self.root}/commits"

    def _files(self, folder: str) -> tuple:
        """The folder's path and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _rows(self, folder: str, schema: str) -> list:
        path, files = self._files(folder)
        return self.spark.read.schema(schema).json(folder).orderBy("seq", "gen").collect() if files.exists(path) else []

    def _state(self) -> _State:
        """The commits of the newest snapshot and those after it, one row per ingest."""
        rows = self._rows(f"{self.root}/log", f"{COMMIT_SCHEMA}, epoch int")
        epoch = max((r["epoch"] for r in rows), default=0)
        rows = [r for r in rows if r["epoch"] == epoch] if epoch else self._rows(self._log(0), COMMIT_SCHEMA)
        state = _State(epoch=epoch)
        for row in rows:
            state.take(row)
        return state

    def _checked(self, state: _State) -> int | None:
        if state.shards and self.shards and state.shards != self.shards:
            raise ValueError(f"the store under {self.root} has {state.shards} shards, not {self.shards}")
        return self.shards

    def _commit(
        self, what: str, gen: int, n_rows: int = 0, shards: int | None = None, next_block: int = 0, level: int = 0, replaces: Sequence[int] = ()
    ) -> None:
        """The last step of every change: what it wrote becomes visible at once."""
        state = self._state()
        self._append(state.epoch, [(state.seq + 1, gen, what, n_rows, shards, next_block, level, list(replaces))])

    def _append(self, epoch: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1).write.mode("append").json(self._log(epoch))

    def reset(self) -> None:
        """Forget everything ingested so far."""
        self._commit(RESET, time.time_ns())

    # -- reading ---------------------------------------------------------------------

    def _read(self, table: str, gens: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{table}/gen={g}" for g in gens])

    def _chunks(self, gens: Sequence[int]) -> DataFrame:
        stored = self.spark.read.schema(CHUNK_SCHEMA).option("basePath", f"{self.root}/chunks")
        return stored.parquet(*[f"{self.root}/chunks/gen={g}" for g in gens]).drop("gen")

    def count(self) -> int:
        return sum(row["n_rows"] for row in self._state().chunks.values())

    def chunks(self) -> DataFrame:
        gens = list(self._state().chunks)
        if not gens:
            raise ValueError(f"nothing is stored under {self.root}")
        return self._chunks(gens)

    def vectors(self) -> DataFrame:
        return self._read("vectors", list(self._state().chunks))

    def keywords(self) -> KeywordIndex | None:
        """The keyword index, or None before the first one is built."""
        state = self._state()
        self._checked(state)
        gens = list(state.postings)
        return read_keywords(self.spark, self.root, gens, [state.postings[g]["shards"] for g in gens]) if gens else None

    def _cells(self, version: int) -> str:
        return f"{self.root}/cells/version={version}"

    def vector_index(self) -> VectorIndex | None:
        """The index over cells of vectors, or None before `index_vectors`."""
        state = self._state()
        if state.cells is None or not state.chunks:
            return None
        root = self._cells(state.cells)
        return VectorIndex.read(self.spark, VectorIndex.read_centres(self.spark, root), [f"{root}/gen={g}" for g in state.chunks])

    def corpus(self) -> Corpus:
        return Corpus(self.chunks(), self.vectors(), self.keywords(), self.vector_index())

    # -- writing ---------------------------------------------------------------------

    def _unknown(self, fresh: DataFrame, gens: list[int], small: bool) -> DataFrame:
        """The rows whose id is not stored.

        Of a small ingest the ids are looked up: stored ids are sorted and have
        Bloom filters, so most row groups are skipped.  A large one meets all
        ids, and nothing but ids.
        """
        ids = self._read("ids", gens)
        most = int(self.spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))
        if small:
            own = [r["chunk_id"] for r in fresh.select("chunk_id").limit(most + 1).collect()]
            if len(own) <= most:
                ids = ids.where(F.col("chunk_id").isin(own))
        return fresh.join(ids, "chunk_id", "left_anti")

    def _write_ids(self, ids: DataFrame, gen: int) -> None:
        placed = ids.select("chunk_id").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
        filters = {"parquet.bloom.filter.enabled#chunk_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        placed.write.options(**filters).parquet(f"{self.root}/ids/gen={gen}")

    def _write_cells(self, version: int, gen: int, centre: np.ndarray | None = None) -> None:
        root = self._cells(version)
        known = VectorIndex.read_centres(self.spark, root) if centre is None else centre
        VectorIndex.write(self._read("vectors", [gen]), f"{root}/gen={gen}", known)

    def add(
        self, chunks: DataFrame, order: list[Column], providers: Providers = OFFLINE, build_keywords: bool = True
    ) -> int:
        """Store new chunks in the given order; an id that is there already is left alone.

        Returns the number of chunks stored.  Chunks, vectors and index become
        visible together, with the commit at the end.
        """
        state, gen = self._state(), time.time_ns()
        shards, first_block = self._checked(state), state.next_block
        fresh = keep_first(chunks, order)
        if state.chunks:
            fresh = self._unknown(fresh, list(state.chunks), estimated_bytes(chunks) <= LISTED_BYTES)
        # Range partitions in order, then ids that rise with partition and row.
        placed = fresh.repartitionByRange(*order).sortWithinPartitions(*order)
        idx = F.lit(first_block << BLOCK_ROW_BITS) + F.monotonically_increasing_id()
        symbol = F.coalesce("symbol", F.lit("")).alias("symbol")
        columns = [symbol if c == "symbol" else F.col(c) for c in META]
        # One range partition is one block, so every task writes one file.
        numbered = placed.select(idx.alias("chunk_idx"), *columns).withColumn("block", block_of(F.col("chunk_idx")))
        numbered.write.partitionBy("block").parquet(f"{self.root}/chunks/gen={gen}")
        written = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{self.root}/chunks/gen={gen}")
        self._write_ids(written, gen)
        embedded(written, providers).write.parquet(f"{self.root}/vectors/gen={gen}")
        if state.cells is not None:
            self._write_cells(state.cells, gen)
        found = written.agg(
            F.count("*").alias("rows"), F.max("block").alias("last"), F.sum(F.octet_length("text")).alias("bytes")
        ).first()
        shards = shards or sized_shards(found["bytes"] or 0)
        if build_keywords:
            write_keywords(written, self.root, gen, shards, found["bytes"] or 0, list(state.postings))
        next_block = first_block if found["last"] is None else found["last"] + 1
        self._commit(INDEXED if build_keywords else CHUNKS, gen, found["rows"], shards, next_block)
        return found["rows"]

    def rebuild_keywords(self) -> int:
        """Index every stored chunk anew, without embedding anything."""
        state, gen = self._state(), time.time_ns()
        text_bytes = self._bytes(list(state.chunks))
        shards = self._checked(state) or sized_shards(text_bytes)
        write_keywords(self.chunks(), self.root, gen, shards, text_bytes)
        self._commit(REBUILT, gen, shards=shards, next_block=state.next_block)
        return self.count()

    def _bytes(self, gens: list[int]) -> int:
        return self._chunks(gens).agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def index_vectors(self, cells: int | None = None) -> None:
        """Sort all vectors into cells; later ingests are added to the same cells."""
        state, version = self._state(), time.time_ns()
        centre = centroids(self.vectors(), cells)
        VectorIndex.write_centres(self.spark, self._cells(version), centre)
        for gen in state.chunks:
            self._write_cells(version, gen, centre)
        self._commit(CELLS, version, next_block=state.next_block)

    # -- growth ----------------------------------------------------------------------

    @staticmethod
    def _ripe(live: dict[int, object], fanout: int) -> tuple[list[int], int] | None:
        """The oldest `fanout` generations of a level that has so many."""
        levels: dict[int, list[int]] = {}
        for gen, row in live.items():
            levels.setdefault(row["level"] or 0, []).append(gen)
        return next(((levels[n][:fanout], n) for n in sorted(levels) if len(levels[n]) >= fanout), None)

    def compact(self, fanout: int = FANOUT) -> int:
        """Merge generations, `fanout` of a level into one of the next; returns the number of merges.

        Every merge is a change of its own, visible with its commit.
        """
        merges = 0
        while True:
            state = self._state()
            if found := self._ripe(state.chunks, fanout):
                self._merge_chunks(state, *found)
            elif found := self._ripe(state.postings, fanout):
                self._merge_postings(state, *found)
            else:
                break
            merges += 1
        if merges:
            self._snapshot()
        return merges

    def _merge_chunks(self, state: _State, gens: list[int], level: int) -> None:
        gen = time.time_ns()
        # A block keeps its file, so texts are copied where they are read: hits go on pruning them by block.
        self._chunks(gens).sortWithinPartitions("block", "chunk_idx").write.partitionBy("block").parquet(f"{self.root}/chunks/gen={gen}")
        self._read("vectors", gens).repartitionByRange("chunk_idx").write.parquet(f"{self.root}/vectors/gen={gen}")
        self._write_ids(self._read("ids", gens), gen)
        if state.cells is not None:
            self._write_cells(state.cells, gen)
        rows = sum(state.chunks[g]["n_rows"] for g in gens)
        self._commit(MERGED_CHUNKS, gen, rows, state.shards, state.next_block, level + 1, gens)

    def _merge_postings(self, state: _State, gens: list[int], level: int) -> None:
        """Postings of several generations in one, with more shards if there is more text."""
        gen = time.time_ns()
        old = [state.postings[g]["shards"] for g in gens]
        text_bytes = self._text_bytes(gens)
        shards = self._checked(state) or max(*old, sized_shards(text_bytes))
        index = read_keywords(self.spark, self.root, gens, old)
        _write_postings(index.postings.repartition(pieces(shards, text_bytes), "chunk_idx"), self.root, gen, shards)
        self._read("sizes", gens).agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl")).write.parquet(f"{self.root}/sizes/gen={gen}")
        _write_terms(index.frequencies.groupBy("term").agg(F.sum("df").alias("df")), self.root, gen)
        # The merged generation may come to be the last one: it keeps the frequencies of the whole index.
        self._read("frequencies", [list(state.postings)[-1]]).coalesce(1).write.parquet(f"{self.root}/frequencies/gen={gen}")
        self._commit(MERGED_POSTINGS, gen, 0, shards, state.next_block, level + 1, gens)

    def _text_bytes(self, gens: list[int]) -> int:
        """The text of generations, told from the bytes of their postings' words."""
        return (self._read("sizes", gens).agg(F.sum("sum_dl")).first()[0] or 0) * TOKEN_BYTES

    def _snapshot(self) -> None:
        """Write what is visible as the first commits of a new epoch; earlier ones are not read again."""
        state = self._state()
        rows, seq = [], state.seq + 1
        for what, live in ((CHUNKS, state.chunks), (POSTINGS, state.postings)):
            for gen, row in live.items():
                rows.append((seq + len(rows), gen, what, row["n_rows"], row["shards"], state.next_block, row["level"], []))
        if state.cells is not None:
            rows.append((seq + len(rows), state.cells, CELLS, 0, None, state.next_block, 0, []))
        self._append(state.epoch + 1, rows)

    def vacuum(self) -> int:
        """Delete generations, and commits before the last snapshot, that no reader of this state needs.

        Not while an ingest or a query runs.  Returns the number of folders deleted.
        """
        state = self._state()
        live = {*map(str, state.chunks), *map(str, state.postings)}
        (root, files), deleted = self._files(self.root), 0

        def folders(path) -> list:
            return [x.getPath() for x in files.listStatus(path) if x.isDirectory()] if files.exists(path) else []

        for table in folders(root):
            name = table.getName()
            nested = [p for version in folders(table) for p in folders(version)] if name == "cells" else folders(table)
            for path in nested:
                key, _, value = path.getName().partition("=")
                stale = key == "gen" and value not in live or name == "log" and int(value) < state.epoch
                if stale:
                    deleted += bool(files.delete(path, True))
        return deleted


def embedded(chunks: DataFrame, providers: Providers) -> DataFrame:
    """(chunk_idx, embedding), by requests of many texts where the provider takes them."""
    if providers.embed_batch is None:
        return chunks.select("chunk_idx", providers.embed(F.col("text")).alias("embedding"))
    return batched_embeddings(chunks.select("chunk_idx", "text"), providers.embed_batch)
