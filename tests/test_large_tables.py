"""What larger tables showed: ties of scores, work that grows with the square, joins that nothing reads."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from catalith.operators import search


def test_sums_of_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k, w) for k, ws in enumerate(itertools.permutations([0.1, 0.7, 0.3, 1e-3, 2.9])) for w in ws]
    df = spark.createDataFrame(rows, "k int, w double").coalesce(1)
    assert df.groupBy("k").agg(search.exact_sum(F.col("w")).alias("s")).select("s").distinct().count() == 1


def test_index_upsert_asks_for_its_three_terms():
    from catalith.plans import search as plans

    assert plans.INDEX_UPSERT_TERMS.split() == ["the", "and", "license"]
    assert "'license', 0, 3, false, false" in plans.ORACLES["index_upsert"]


def test_the_median_is_exact_beyond_what_the_driver_gets(spark):
    from catalith.llm import quality_rules

    r = np.random.default_rng(5)
    for n in (1, 2, 301, 1000):
        x = np.append(r.normal(size=n - n // 3), np.full(n // 3, 0.25))
        assert quality_rules.median(spark.createDataFrame([(float(v),) for v in x], "x double"), few=10) == np.median(x)


def test_the_target_is_every_labelled_row(spark):
    from catalith.llm import quality_rules

    n = 20_300
    docs = spark.range(n).selectExpr("id as doc_id", "'plain good words' as text").unionByName(spark.range(n, n + 50).selectExpr("id as doc_id", "'other' as text"))
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality")
    weight, _ = quality_rules.fit(docs, labels)
    raw = 5 * n  # words and pairs of a labelled text
    assert np.isclose(weight.min(), np.log(1 / (raw + quality_rules.BUCKETS)) - np.log(51 / (raw + 50 + quality_rules.BUCKETS)), atol=1e-9)


def test_vectors_are_copied_no_more_often_where_rows_are_more(spark):
    from catalith.operators import vectors

    assert vectors.grid_blocks(33_000) == vectors.grid_blocks(500_000) == vectors.GRID
    assert vectors.grid_blocks(10) == 1 and vectors.grid_blocks(6_553_600) == 100  # memory is bounded beyond


def test_a_target_goes_to_a_bundle_once(spark, tmp_path):
    from catalith.operators import vector_index, vectors

    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(str(i), "API", r.normal(size=8).tolist()) for i in range(300)], "doc_id string, doc_type string, vector array<double>")
    index = vector_index.write_vector_index(rows, str(tmp_path), lists=20, block_rows=8)
    targets = index.rows.select("doc_id", "v")
    bundles, of = vector_index._bundles(index)
    asked = vector_index._asked_bundles(index, targets, bundles, 0.0)
    assert index.blocks.count() > 30 and of.count() == index.blocks.count()
    assert asked.count() <= 300 * len(bundles) and asked.select("target", "bundle").distinct().count() == asked.count()
    whole = {tuple(x) for x in vectors.all_neighbours(rows, threshold=0.3).select("target_doc_id", "doc_id", "rank").collect()}
    assert whole == {tuple(x) for x in vector_index.exact_neighbours(index, targets, threshold=0.3).select("target_doc_id", "doc_id", "rank").collect()}


def test_impacts_of_runs_are_those_of_all_rows_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, " ".join("abcab"[: 1 + i % 5])) for i in range(400)], "list_id long, desc string")
    postings = search.build_index(docs, {"desc": "desc"}).postings
    runs = search.run_impacts(postings.sortWithinPartitions("term", "list_id"))
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.select("field", "term", "range", "tf", "len").collect()))
    assert rows(search.largest_impacts(runs)) == rows(search.term_impacts(postings))


def test_a_blank_request_builds_no_index_and_texts_are_not_joined_with_dates(spark, monkeypatch):
    from catalith.plans import search as plans
    from catalith.plans import vectors

    monkeypatch.setattr(plans, "stored", lambda *x: 1 / 0)
    assert plans.search_or_browse(spark, "/root/testdata/sf0.001").count() == 20
    for q in (vectors.embedding_text, vectors.embedding_text_short, vectors.embed_listings):
        assert "Join" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
