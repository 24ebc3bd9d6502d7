import json
import textwrap

import pytest
from pyspark.sql import functions as F

from gleaner import cli
from gleaner.engine import Engine
from gleaner.operators import keyword
from gleaner.plans import retrieve as plan
from gleaner.plans.answering import agentic, ask, search_turn
from gleaner.plans.evaluation import judged
from gleaner.providers import OFFLINE, Providers, Refused, model_column
from gleaner.sources.questions import combine, read_questions, read_results, write_questions, write_results
from gleaner.sources.store import Store
from gleaner.streaming.ingest import ingest_items_stream
from test_ingest import SOURCE, item

FILLER = "    # one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen\n" * 3 + "    return n\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    tree = tmp_path_factory.mktemp("tree")
    (tree / "src").mkdir()
    (tree / "src" / "pool.py").write_text(SOURCE)
    (tree / "src" / "queue.py").write_text(
        f"def enqueue_task(n):\n{FILLER}\n\nclass Worker:\n    def drain(self, n):\n{textwrap.indent(FILLER, '    ')}"
    )
    (tree / "guide.md").write_text("A pool limits how many tasks run at once. Workers drain the queue in order. " * 3)
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")), shards=3)
    engine.tree = str(tree)
    assert engine.ingest(str(tree)) > 4
    return engine


def test_ids_rise_in_source_order(engine):
    rows = engine.store.chunks().orderBy("chunk_idx").collect()
    assert [r["source_path"] for r in rows] == sorted(r["source_path"] for r in rows)
    assert len({r["chunk_idx"] for r in rows}) == len(rows) == engine.store.count()


@pytest.mark.parametrize("method", plan.RETRIEVAL_METHODS)
def test_every_method_finds_the_named_symbol(engine, method):
    hits = engine.retrieve(engine.questions("How does Pool.take work?"), 3, method).orderBy("rank").collect()
    assert 0 < len(hits) <= 3 and [h["rank"] for h in hits] == list(range(len(hits)))
    if method != "vector":
        assert hits[0]["symbol"] == "Pool.take"
    if method.startswith("hybrid"):
        assert "symbol" in hits[0]["source"]
    if "rerank" in method:
        assert all(("code" if "code" in method else "rerank") in h["source"] for h in hits[1:])
    if "hyde" in method:
        assert any("vector+hyde" in h["source"] for h in hits)


def test_unknown_methods(engine):
    assert plan.resolve("routed") == plan.resolve("anything") == plan.Method("hybrid")
    assert plan.resolve("vector", rerank=True).rerank
    with pytest.raises(ValueError):
        engine.retrieve(engine.questions("q"), 3, "anything")
    with pytest.raises(ValueError):
        engine.ask(engine.questions("q"), 3, "anything")


def test_shuffled_hydration_gives_the_same_hits(engine, monkeypatch):
    questions = engine.questions("How does Pool.take work?", "drain the queue")
    shown = lambda: sorted(map(tuple, engine.retrieve(questions, 4).select("qid", "rank", "chunk_id", "source").collect()))
    expected = shown()
    monkeypatch.setattr(plan, "BROADCAST_BYTES", 0)
    assert shown() == expected


def test_routed_answers_with_fallback(engine):
    never = Providers(answer=lambda q, c: F.when(F.contains(q, F.lit("Pool")), F.lit("<INSUFFICIENT_CONTEXT>")).otherwise(OFFLINE.answer(q, c)))
    questions = engine.questions("How does Pool.take work?", "What is a queue?", "In what order do tasks run?")
    answers, hits = ask(questions, engine.store.corpus(), 4, "routed", never)
    got = {r["qid"]: r for r in answers.collect()}
    assert {q: (r["used_fallback"], r["routed_to"]) for q, r in got.items()} == {
        "q0": (True, "hybrid → agentic"), "q1": (False, "hybrid_hyde"), "q2": (False, "agentic"),
    }
    assert got["q1"]["answer"].startswith("[#1]") and got["q2"]["turns"] >= 2
    phases = {(r["qid"], r["phase"]) for r in hits.select("qid", "phase").collect()}
    assert phases == {("q0", "first"), ("q0", "final"), ("q1", "final"), ("q2", "final")}
    plain, _ = ask(questions, engine.store.corpus(), 4, "routed", never, allow_fallback=False)
    assert not plain.where("used_fallback").count() and plain.count() == 3


def test_agentic_walk(engine):
    answers, hits = agentic(engine.questions("In what order do tasks drain?"), engine.store.corpus(), max_turns=3)
    rows = hits.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    assert [r["turn"] for r in rows] == sorted(r["turn"] for r in rows)
    row = answers.first()
    assert row["turns"] <= 3 and row["trace"][0] == "turn 1: search('In what order do tasks drain?', k=5)"


def test_the_planner_reads_listings_and_may_answer(engine):
    questions = engine.questions("In what order do tasks drain?", "What is 'this'?", "zzqx")
    seen = []

    def planner(asked, hits, turn, listings):
        searches = asked.select("qid", F.lit(0).alias("call"), F.col("question").alias("query"), F.lit(2).alias("k"))
        if turn == 0:
            return searches.withColumn("answer", F.when(F.col("qid") == "q1", "known already"))
        seen.extend(listings.collect())
        return searches.withColumn("answer", F.when(F.col("qid") == "q0", "in order"))

    answers, hits = agentic(questions, engine.store.corpus(), planner=planner, max_turns=2)
    got = {r["qid"]: r for r in answers.collect()}
    assert (got["q0"]["answer"], got["q0"]["turns"], len(got["q0"]["trace"])) == ("in order", 2, 1)
    assert (got["q1"]["answer"], got["q1"]["turns"], got["q1"]["trace"]) == ("known already", 1, [])
    assert got["q2"]["turns"] == 2 and len(got["q2"]["trace"]) == 2 and got["q2"]["answer"].startswith("[1] ")
    assert {(r["qid"], r["turn"]) for r in seen} == {("q0", 0), ("q2", 0)}
    assert all(r["listing"].startswith("[1] ") for r in seen) and hits.where("qid = 'q1'").isEmpty()


def test_an_empty_search_says_so(spark, engine):
    from gleaner.plans.answering import cumulative, previews

    searches = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "qid string, turn int, call int")
    found = search_turn(searches.where("qid = 'a'").selectExpr("qid", "call", "'drain' AS query", "2 AS k"), engine.store.corpus(), 0)
    listed = {r["qid"]: r["listing"] for r in previews(cumulative(found), searches).collect()}
    assert listed["b"] == "No results." and listed["a"].startswith("[1] ")


def test_strings_are_quoted_as_python_does(spark):
    from gleaner.functions import layout

    texts = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "two\nlines\tand"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", layout.quoted(F.col("t")).alias("q")).collect()
    assert all(r["q"] == repr(r["t"]) for r in rows)


def test_a_turn_runs_equal_searches_once_and_keeps_each_k(engine, spark):
    searches = spark.createDataFrame(
        [("a", 0, "pool tasks", 2), ("b", 0, "pool tasks", 2), ("b", 1, "drain", 3)], "qid string, call int, query string, k int"
    )
    hits = search_turn(searches, engine.store.corpus(), 0).groupBy("qid", "call").count().collect()
    assert {(r["qid"], r["call"]): r["count"] for r in hits} == {("a", 0): 2, ("b", 0): 2, ("b", 1): 3}


def test_a_cell_without_an_answer_is_no_fact(engine):
    lost = Providers(answer=lambda question, context: F.when(question.contains("order"), "found"))
    questions = engine.questions("In what order do tasks drain?", "Who drains?").withColumns(
        {"category": F.lit("conceptual"), "expected_paths": F.array(F.lit("src")), "expected_symbols": F.array().cast("array<string>")}
    )
    from gleaner.plans.evaluation import evaluate

    facts = evaluate(questions, engine.store.corpus(), ["bm25", "hybrid"], 3, 2, True, lost)
    assert sorted((r["method"], r["run"], r["qid"]) for r in facts.collect()) == [
        (m, run, "q0") for m in ("bm25", "hybrid") for run in (0, 1)
    ]


def test_evaluation_round_trip(engine, spark, tmp_path):
    written = engine.generate(4)
    path = str(tmp_path / "set.yaml")
    assert write_questions(written, path) == written.count() > 0
    questions = combine(read_questions(spark, path), engine.questions("What is a queue?").withColumn("category", F.lit("conceptual")))
    facts = engine.evaluate(questions, ["bm25", "hybrid"], k=3, runs=2).cache()
    assert facts.count() == questions.count() * 4
    named = facts.where("qid <> 'q0'")
    assert named.agg(F.min("p_hit_at_10")).first()[0] == 1 and named.where("judge_score IS NULL").count() == 0
    summary, categories = engine.summarize(facts)
    assert {r["method"]: r["n_runs"] for r in summary.collect()} == {"bm25": 2, "hybrid": 2}
    saved = write_results(facts, summary, categories, str(tmp_path / "out"))
    assert read_results(spark, saved).count() == facts.count()
    skipped = engine.evaluate(questions, ["vector"], k=3, skip_judge=True, sample=1)
    assert skipped.count() == 1 and skipped.first()["judge_score"] is None


def index_rows(index):
    totals = index.totals.first()
    return (
        sorted(map(tuple, index.postings.select("key", "chunk_idx", "tf", "dl").collect())),
        sorted(map(tuple, index.frequencies.groupBy("term").agg(F.sum("df")).collect())),
        [totals[0], round(totals[1], 9), totals[2], round(totals[3], 9)],
    )


def test_appending_equals_rebuilding_and_skips_known_ids(spark, tmp_path, engine):
    store = Store(spark, str(tmp_path / "s"), 2)
    chunks = engine.store.chunks().drop("chunk_idx")
    half = chunks.where("source_path < 'src/pool'")
    order = [F.col("source_path"), F.col("start_line"), F.col("kind")]
    first = store.add(half, order)
    assert first + store.add(chunks.unionByName(half), order) == chunks.count() == store.count()
    assert store.add(half, order) == 0
    appended = index_rows(store.keywords())
    assert store.rebuild_keywords() == chunks.count()
    assert index_rows(store.keywords()) == appended
    store.reset()
    assert store.count() == 0 and store.keywords() is None
    with pytest.raises(ValueError):
        store.chunks()


def test_a_torn_ingest_is_invisible_and_can_be_repeated(spark, tmp_path, engine):
    store = Store(spark, str(tmp_path / "s"), 2)
    chunks = engine.store.chunks().drop("chunk_idx")
    order = [F.col("source_path"), F.col("start_line"), F.col("kind")]
    broken = Providers(embed=lambda text: F.raise_error(F.lit("lost")).cast("array<float>"))
    with pytest.raises(Exception):
        store.add(chunks, order, broken)
    assert store.count() == 0
    assert store.add(chunks, order) == chunks.count() == store.chunks().count()


def test_an_ingest_whose_index_was_lost_is_repeated_whole(spark, tmp_path, engine, monkeypatch):
    from gleaner.sources import store as module

    store = Store(spark, str(tmp_path / "s"), 2)
    chunks = engine.store.chunks().drop("chunk_idx")
    order = [F.col("source_path"), F.col("start_line"), F.col("kind")]

    def lost(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(module, "write_keywords", lost)
        with pytest.raises(RuntimeError):
            store.add(chunks, order)
    assert store.count() == 0 and store.keywords() is None
    assert store.add(chunks, order) == chunks.count() == store.keywords().totals.first()["n_docs"]


def test_the_number_of_shards_is_kept_with_the_store(spark, engine):
    assert Store(spark, engine.root).keywords().totals.first()["n_docs"] == engine.store.count()
    with pytest.raises(ValueError, match="3 shards"):
        Store(spark, engine.root, 4).keywords()


def test_shards_follow_the_text():
    from gleaner.sources.store import sized_shards

    assert sized_shards(0) == 8 and sized_shards(100 << 30) == 50 and sized_shards(10**18) == 65_536


def test_there_is_no_last_ingest(spark, tmp_path, engine):
    """After very many ingests ids go on rising, and everything is found."""
    store = Store(spark, str(tmp_path / "s"), 2)
    store._commit("chunks", 0, shards=2, next_block=2_000_000)
    spark.createDataFrame([(5_000, 1, "reset", 0, None, 2_000_000)], "seq bigint, gen bigint, what string, n_rows bigint, shards int, next_block bigint").write.mode("append").json(f"{store.root}/commits")
    chunks = engine.store.chunks().drop("chunk_idx")
    order = [F.col("source_path"), F.col("start_line"), F.col("kind")]
    half = chunks.where("source_path < 'src/pool'")
    store.add(half, order)
    store._commit("keywords", 0, shards=2, next_block=3_000_000)
    store.add(chunks, order)
    ids = [r[0] for r in store.chunks().select("chunk_idx").collect()]
    assert len(set(ids)) == chunks.count() and max(ids) >> 33 >= 3_000_000
    asked = spark.createDataFrame([("q", "How does Pool.take work?")], "qid string, question string")
    from gleaner.plans.retrieve import retrieve

    found = retrieve(asked, store.corpus(), 3, "bm25").where("rank = 0").first()
    assert found["chunk_id"] == "src/pool.py:13-16:method:Pool.take"


def test_a_second_session_reads_the_stored_index(spark, engine):
    other = spark.newSession()
    index = Store(other, engine.root, 3).keywords()
    questions = other.createDataFrame([("q", "How does Pool.take work?")], "qid string, question string")
    assert keyword.keyword_leg(questions, index, 3).count() == 3


def test_items_batch_and_stream(spark, tmp_path):
    lines = [item(i, body=f"tasks wait in queue {i}", state="closed", updated_at=f"2024-01-{i:02d}") for i in range(1, 8)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines[:5]))
    batch = Engine(spark, str(tmp_path / "batch"), shards=2)
    assert batch.ingest_items("o/r", str(tmp_path / "in"), max_items=3) == 3
    assert {r["source_path"] for r in batch.store.chunks().collect()} == {f"_gh/r/issues/{i}" for i in (3, 4, 5)}
    with pytest.raises(ValueError):
        batch.ingest_items("r", str(tmp_path / "in"))

    store = Store(spark, str(tmp_path / "stream"), 2)
    run = lambda: ingest_items_stream(spark.readStream.text(str(tmp_path / "in")), store, "r", str(tmp_path / "cp")).awaitTermination()
    run()
    assert store.count() == 5
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(lines[3:]))
    run()
    assert store.count() == 7 and index_rows(store.keywords())[2][0] == 7


def test_model_column_retries_and_falls_back(spark):
    def flaky(text):
        raise OSError("busy")

    def refuses(text):
        raise Refused("no")

    df = spark.createDataFrame([("a",), ("b",)], "t string")
    backed = model_column(flaky, lambda t: t.upper(), pause=lambda s: None)
    assert [r[0] for r in df.select(backed("t")).collect()] == ["A", "B"]
    with pytest.raises(Exception, match="busy"):
        df.select(model_column(flaky, pause=lambda s: None)("t")).collect()
    with pytest.raises(Exception, match="no"):
        df.select(model_column(refuses, lambda t: t, pause=lambda s: None)("t")).collect()


def test_a_failing_judge_leaves_nulls(spark):
    def judge(question, answer):
        if answer == "bad":
            raise OSError("down")
        return '{"score": 2, "reason": "fine"}'

    providers = Providers(judge=model_column(judge, pause=lambda s: None, forgive=True))
    df = spark.createDataFrame([("q", "good"), ("q", "bad")], "question string, answer string")
    got = {r["answer"]: (r["judge_score"], r["judge_reason"]) for r in judged(df, providers).collect()}
    assert got == {"good": (2, "fine"), "bad": (None, None)}


def test_command_line(spark, engine, tmp_path, capsys):
    store = str(tmp_path / "cli")
    base = ["--store", store, "--shards", "2"]
    cli.main([*base, "ingest", engine.tree])
    cli.main([*base, "ask", "How does Pool.take work?", "--k", "3"])
    out = capsys.readouterr().out
    assert "Stored" in out and "Sources:" in out and "src/pool.py:13-16 (method · Pool.take)" in out
    (tmp_path / "items.jsonl").write_text(item(7, body="queue", state="closed"))
    cli.main([*base, "ingest-items", "o/r", str(tmp_path / "items.jsonl")])
    cli.main([*base, "gen-eval", "--n", "3", "--output", str(tmp_path / "q.yaml")])
    cli.main([*base, "eval", "--questions", str(tmp_path / "q.yaml"), "--methods", "bm25", "--k", "3", "--output-dir", str(tmp_path / "out")])
    out = capsys.readouterr().out
    assert "Added 1 chunks" in out and "Was the right file found?" in out and "Saved" in out
    saved = next((tmp_path / "out").glob("run_*/summary/*.json"))
    assert json.loads(saved.read_text().splitlines()[0])["method"] == "bm25"
