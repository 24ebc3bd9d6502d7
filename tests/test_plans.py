"""What the plans must look like to hold at a thousand times the data."""

import pytest
from pyspark.sql import functions as F

from catalogue import retrieval, views
from gleaner.engine import Engine
from gleaner.operators import keyword, vector
from gleaner.plans.retrieve import hydrate, ranked, resolve
from test_ingest import SOURCE

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def hits_plan(spark):
    return plan(keyword.bm25_scores(views.questions(spark, SF), retrieval.index(spark, SF), 10))


def test_scoring_needs_no_shuffle_but_the_top_k(hits_plan):
    scored = hits_plan[hits_plan.index("Exchange hashpartitioning(qid") :]
    assert "MapInArrow" in scored.split("ObjectHashAggregate")[0], "tasks hand on lists"
    between = scored[scored.index("ObjectHashAggregate") : scored.index("BroadcastHashJoin")]
    assert "Exchange" not in between and "CartesianProduct" not in hits_plan and "NestedLoop" not in hits_plan


def test_pairs_of_question_and_chunk_are_no_rows(hits_plan):
    aggregates = [line for line in hits_plan.splitlines() if "Aggregate(" in line]
    assert not [line for line in aggregates if "qid" in line and "chunk_idx" in line]


def test_postings_scan_is_bucketed_and_pruned(spark):
    one = spark.createDataFrame([("q", "How does EnDoc.item_1 work?")], "qid string, question string")
    text = plan(keyword.bm25_scores(one, retrieval.index(spark, SF), 10))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "SelectedBucketsCount" in line)
    assert "key#" in scan and "In(key" in text or "PushedFilters: [IsNotNull(key)" in scan
    assert "gen" in scan.split("PartitionFilters")[1]


def test_raw_scan_reads_only_what_the_index_needs(spark):
    forward = keyword.forward_index(views.corpus(spark, SF))
    text = forward._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in text


def test_vector_search_shuffles_only_the_best_of_each_task(spark):
    text = plan(vector.nearest(views.corpus_vectors(spark, SF), views.question_vectors(spark, SF), 10))
    below = text[text.index("MapInArrow") :]
    assert "Exchange hashpartitioning" not in below.split("FileScan")[0] and "CartesianProduct" not in text


def test_texts_are_read_only_from_blocks_with_hits(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "pool.py").write_text(SOURCE)
    engine = Engine(spark, str(tmp_path / "s"), shards=2)
    engine.ingest(str(tmp_path / "t"))
    corpus = engine.store.corpus()
    hits = ranked(engine.questions("How does Pool.take work?"), corpus, 2, resolve("bm25"))
    text = plan(hydrate(hits, corpus.chunks, 2))
    assert "dynamicpruning" in text and "BroadcastHashJoin" in text


def test_fused_legs_of_reused_shuffles_stay_whole(spark):
    """A leg that is also read elsewhere must not split the groups of the fusion."""
    from gleaner.operators import hybrid
    from gleaner.operators.joins import stack

    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    asked = views.named_questions(spark, SF)
    words = keyword.keyword_leg(asked, retrieval.index(spark, SF), 100)
    near = vector.nearest(views.corpus_vectors(spark, SF), views.question_vectors(spark, SF), 100)
    hits = hybrid.pin_and_cut(hybrid.fuse(near, words), 10, 10)
    legs = [near.where("rank < 10"), words.where("rank < 10"), hits]
    every = stack(*[df.select("qid", "rank", F.lit(i).alias("leg")) for i, df in enumerate(legs)])
    counts = {r["count"] for r in every.groupBy("leg", "qid").count().collect()}
    joined = asked.select("qid").join(every, "qid", "left").groupBy("qid", "leg").count()
    assert counts == {10} == {r["count"] for r in joined.collect()}


def test_long_lists_are_cut_before_the_shuffle_too(spark):
    from gleaner.operators.joins import top_ranked

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    text = plan(top_ranked(df, ["g"], [F.col("id").desc()], 1500))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")
