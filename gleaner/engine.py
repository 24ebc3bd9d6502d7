"""The library's front door: ingest, ask, evaluate, and write new questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import summary
from gleaner.operators.items import BODY_CHARS, item_chunks
from gleaner.operators.sampling import hash_sample
from gleaner.plans.answering import Planner, ask, symbol_planner
from gleaner.plans.evaluation import evaluate, generate_questions
from gleaner.plans.retrieve import METHODS, RETRIEVAL_METHODS, retrieve
from gleaner.providers import OFFLINE, Providers
from gleaner.sources.files import read_tree, tree_chunks
from gleaner.sources.store import Store
from gleaner.sources.tracker import read_dump

TREE_ORDER = ("source_path", "ord", "piece")
ITEM_ORDER = ("source_path", "chunk_id")


@dataclass
class Engine:
    """A stored corpus with the providers that answer for it."""

    spark: SparkSession
    root: str
    providers: Providers = OFFLINE
    planner: Planner = symbol_planner
    shards: int | None = None
    keep_pieces: bool = False
    store: Store = field(init=False)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root, self.shards)

    def ingest(self, tree: str, reset: bool = True) -> int:
        """Chunk a source tree into the store; returns the number of new chunks."""
        if reset:
            self.store.reset()
        chunks = tree_chunks(read_tree(self.spark, tree), self.keep_pieces)
        return self.store.add(chunks, [F.col(c) for c in TREE_ORDER], self.providers)

    def ingest_items(self, repo: str, dump: str | DataFrame, max_items: int | None = None, body_chars: int | None = BODY_CHARS) -> int:
        """Add closed tracker items of owner/repo to the stored corpus: all, or those updated last.

        Bodies are cut to `body_chars` characters, or not if it is None.
        """
        if "/" not in repo:
            raise ValueError("repo must be owner/repo")
        items = dump if isinstance(dump, DataFrame) else read_dump(self.spark, dump, max_items)
        chunks = item_chunks(items, repo.split("/", 1)[1], body_chars)
        return self.store.add(chunks, [F.col(c) for c in ITEM_ORDER], self.providers)

    def questions(self, *texts: str) -> DataFrame:
        return self.spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, question string")

    def retrieve(self, questions: DataFrame, k: int = 6, method: str = "hybrid", **flags: bool) -> DataFrame:
        """Ranked chunks of every question, without an answer."""
        if method not in RETRIEVAL_METHODS:
            raise ValueError(f"unknown method {method!r}; one of {', '.join(RETRIEVAL_METHODS)}")
        return retrieve(questions, self.store.corpus(), k, method, self.providers, **flags)

    def ask(
        self, questions: DataFrame, k: int = 6, method: str = "routed", allow_fallback: bool = True
    ) -> tuple[DataFrame, DataFrame]:
        """(answers, hits) of all questions."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
        return ask(questions, self.store.corpus(), k, method, self.providers, self.planner, allow_fallback)

    def evaluate(
        self,
        questions: DataFrame,
        methods: list[str],
        k: int = 10,
        runs: int = 1,
        skip_judge: bool = False,
        sample: int = 0,
    ) -> DataFrame:
        """Fact table, one row per method, run and question."""
        unknown = [m for m in methods if m not in METHODS]
        if unknown:
            raise ValueError(f"unknown methods {unknown}")
        if sample > 0:
            questions = hash_sample(questions, sample, "qid")
        return evaluate(questions, self.store.corpus(), methods, k, runs, skip_judge, self.providers, self.planner)

    @staticmethod
    def summarize(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
        return summary.by_method(facts), summary.by_category(facts)

    def generate(self, n: int, seed: int = 42) -> DataFrame:
        """Questions about sampled chunks, each with its chunk as the expected hit."""
        return generate_questions(self.store.chunks(), n, seed, self.providers)
