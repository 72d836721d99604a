"""Small cases of the catalog operators that the SQL comparison does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalith.functions import coerce, text
from catalith.operators import detail, listing, lookup, paging, ranks, recommendations, search, search_pages, stats, vectors
from catalith.sources import ingest, listings, segments, stores

T = dt.datetime(2024, 1, 1)
DOC = "list_id long, token_count long, generated_at timestamp, markdown string"


def as_of():
    return F.lit("2024-02-01").cast("timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    api = spark.createDataFrame(
        [(1, "a_b", None, "x<br/>y", "org", "c", 5, None, T), (2, "two", None, "", None, None, 5, None, None), (3, "three", None, None, "org", "c", None, None, T)],
        "list_id long, list_title string, title string, desc string, org_nm string, new_category_nm string, request_cnt long, created_at timestamp, updated_at timestamp",
    )
    file = spark.createDataFrame(
        [(1, None, "file one", None, "dept", None, T), (7, "", "file seven", "", "dept", 9, None), (None, "no id", "t", "o", None, 3, T)],
        "list_id long, list_title string, title string, org_nm string, dept_nm string, download_cnt long, updated_at timestamp",
    ).withColumns({"desc": F.lit("d"), "created_at": F.lit(None).cast("timestamp")})
    api_docs = spark.createDataFrame([(1, 10, T, "m"), (1, 20, T, "n"), (99, 7, T, "only")], DOC)
    file_docs = spark.createDataFrame([(7, 30, T, "f"), (50, 4, T, "g")], DOC)
    return api, file, api_docs, file_docs


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_unified_keeps_first_match_and_api_over_file(tables):
    kept = {r["list_id"]: r for r in listing.keep_first(listing.unified(*tables)).collect()}
    assert kept[1]["data_type"] == "API" and kept[1]["token_count"] == 10 and kept[1]["has_generated_doc"]
    assert kept[7]["list_title"] == "" and kept[7]["org_nm"] == ""  # empty strings stay
    assert kept[3]["popularity"] == 0 and None in kept
    last = {r["list_id"]: r["data_type"] for r in listing.search_documents(tables[0], tables[1]).collect()}
    assert last == {1: "FILE", 2: "API", 3: "API", 7: "FILE"}


def test_rankings_keep_both_kinds_and_last_match(tables):
    made = ranks.rank_rows(*tables)
    popular = ranks.rank_popular(made).orderBy("rank").collect()
    assert [r["rank"] for r in popular] == [1, 2, 3, 4, 5, 6]
    assert [(r["list_id"], r["data_type"]) for r in popular][:3] == [(7, "FILE"), (1, "API"), (2, "API")]
    assert {r["list_title"] for r in popular} >= {"file one", "file seven"}
    assert next(r for r in popular if r["list_id"] == 1 and r["data_type"] == "API")["token_count"] == 20
    assert ranks.distinct_listings(made).first()["total"] == 4  # id 0 does not count
    assert ranks.rank_latest(made, as_of()).where("rank = 1").first()["updated_at"] is None
    assert ranks.rank_counts(made).first().asDict() == {"latest": 6, "popular": 6, "trending": 6}
    assert ranks.metadata_total(ranks.rank_metadata(made, as_of()), "none").first()["total"] == 0


def test_detail_prefers_generated_documents(tables):
    found = {r["list_id"]: r for r in detail.details(*tables, "http://h/").collect()}
    assert found[1]["markdown"] == "m" and found[1]["description"] == "x\ny" and found[1]["detail_url"] == "http://h/1/openapi.do"
    assert found[7]["list_title"] == "file seven" and found[7]["data_type"] == "FILE"
    assert found[99]["generated_status"] and found[99]["list_title"] is None and found[99]["keywords"] == []
    assert found[2]["description"] is None and not found[2]["generated_status"]


@pytest.mark.parametrize(("asked", "given"), [((0, 10), (1, 10)), ((1, 0), (1, 1)), ((1, 500), (1, 100))])
def test_pages_are_clamped(asked, given):
    page = paging.clamp(*asked)
    assert (page.number, page.size) == given


def test_page_facts():
    assert paging.facts(21, paging.clamp(1, 10))["total_pages"] == 3
    assert paging.facts(0, paging.clamp(1, 10))["total_pages"] == 0
    assert paging.clamp(50, 20).in_snapshot and not paging.clamp(51, 20).in_snapshot and not paging.clamp(143, 7).in_snapshot
    for bad in (lambda: paging.facts(21, paging.clamp(4, 10)), lambda: paging.checked(0, 5), lambda: listing.by_sort("x"), lambda: listing.by_columns({"list_id": "asc"})):
        with pytest.raises(ValueError):
            bad()


def test_pages_partition_the_order(tables):
    kept = listing.keep_first(listing.unified(*tables))
    seen = [r["list_id"] for n in (1, 2, 3) for r in paging.take(kept, listing.by_sort("popular"), paging.clamp(n, 2)).collect()]
    assert sorted(map(str, seen)) == ["1", "2", "3", "7", "None"]


def test_coercions(spark):
    df = spark.createDataFrame([("12", "a", None), ("x", "", ["k"]), (None, None, ["a", "b"])], "n string, s string, l array<string>")
    got = df.select(coerce.int_or(F.col("n"), 4).alias("n"), coerce.falsy_or(F.col("s"), F.lit("z")).alias("f"), coerce.null_or(F.col("s"), F.lit("z")).alias("i"), coerce.text_list(df, "l").alias("l"))
    assert [tuple(r) for r in got.collect()] == [(12, "a", "a", []), (4, "z", "", ["k"]), (4, "z", "z", ["a", "b"])]
    one = spark.range(1).select(coerce.iso(F.lit("2024-01-01 00:00:00.5").cast("timestamp")).alias("a"), coerce.iso(F.lit("2024-01-01").cast("timestamp")).alias("b"), coerce.strip(F.lit("\t a ")).alias("c"))
    assert tuple(one.first()) == ("2024-01-01T00:00:00.500000", "2024-01-01T00:00:00", "a")


def test_analyzers(spark):
    one = spark.range(1).select(
        text.english(F.lit("The Cities, boxes and Kés")).alias("e"), text.char_grams(F.lit("abc")).alias("g"), text.with_synonyms(F.array(F.lit("car"), F.lit("x")), {"car": ["auto"]}).alias("s"), text.highlight(F.lit("Red redder red"), ["red"]).alias("h")
    ).first()
    assert (one.e, one.g, one.s, one.h) == (["citi", "box", "ké"], ["ab", "abc", "bc"], ["car", "auto", "x"], "<em>Red</em> redder <em>red</em>")


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(1, "small red ring", "acme"), (2, "red ring small", "acme"), (3, "blue box", None), (4, None, "ring")], "list_id long, list_title string, org_nm string")
    return search.build_index(docs, {"list_title": "list_title", "org_nm": "org_nm"})


def test_search_phrases_edits_and_fallback(index):
    ids = lambda df: {r["list_id"] for r in df.collect()}
    assert ids(search.search_titles(index, "red ring", exact=True)) == {1, 2}
    assert ids(search.search_titles(index, "small red", exact=True)) == {1}
    assert ids(search.search_titles(index, "smal ring")) == {1, 2}
    strict, relaxed = ids(search.search_adaptive(index, "red ring", 2)), ids(search.search_adaptive(index, "red ring", 3))
    assert strict <= relaxed
    assert ids(search.search_weighted(index, [])) == set() and ids(search.search_titles(index, "...")) == set()
    assert ids(search.search_weighted(index, ["bleu box"], [2.0])) == {3}


def test_fields_have_analyzers_on_both_sides(spark):
    docs = spark.createDataFrame(
        [(1, "boxes of cities", ["Big Data", "x"], "Road Works"), (2, "box of a city", ["Data"], "Road"), (3, None, None, "")], "list_id long, title string, keywords array<string>, category_nm string"
    )
    index = search.build_index(docs)
    ids = lambda text, f: {r["list_id"] for r in search.bm25(index, text, {f: 1.0}).collect()}
    assert ids("boxes cities", "title") == ids("boxing of the city", "title") == {1, 2} and ids("boxes cities", "title_alt") == {1}
    assert ids("Data", "keywords") == {2} and ids("Big Data", "keywords") == {1} and ids("data", "keywords") == set()
    assert ids("Road Works", "category_nm") == {1} and ids("works", "category_nm") == set()


def test_stored_index_is_read_by_term_and_takes_later_runs(spark, tables, tmp_path):
    api, file = tables[:2]
    folder = str(tmp_path / "index")
    assert ingest.index_listings(api, file, folder) == 4
    index = segments.read_index(spark, folder)
    hits = lambda text: {r["list_id"] for r in search.bm25(segments.read_index(spark, folder), text, {"list_title": 1.0}).collect()}
    plan = search.bm25(index, "three", {"list_title": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,three)" in plan or "In(term, [three])" in plan
    assert hits("three") == {3} and hits("two") == {2} and index.fields.where("field = 'list_title'").first()["docs"] == 2
    later = api.where("list_id = 3").withColumn("list_title", F.lit("now two")).unionByName(api.where("list_id = 2").withColumns({"list_id": F.lit(30).cast("long"), "list_title": F.lit("new")}))
    assert ingest.index_listings(later, file.limit(0), folder) == 2
    assert hits("three") == set() and hits("two") == {2, 3} and hits("new") == {30}
    assert segments.read_docs(spark, folder).count() == 5
    assert segments.read_index(spark, folder).fields.where("field = 'list_title'").first()["docs"] == 3
    assert ingest.index_listings(later, file.limit(0), folder, recreate=True) == 2 and hits("two") == {3}


def test_many_variants_are_joined(spark, index, monkeypatch):
    want = rows(search.search_titles(index, "smal ring"), "list_id")
    monkeypatch.setattr(search, "MAX_LITERALS", 0)
    assert rows(search.search_titles(index, "smal ring"), "list_id") == want == [(1,), (2,)]


def test_blank_requests_browse(spark):
    seen = []
    assert search_pages.search_or_browse(" a ", lambda q: seen.append(q) or "hits", lambda: "page") == "hits" and seen == ["a"]
    assert {search_pages.search_or_browse(q, lambda q: "hits", lambda: "page") for q in (None, "", " \t")} == {"page"}


def test_search_pages_follow_precedence(spark, tables):
    hits = spark.createDataFrame([(1, 3.0), (7, 2.0), (50, 1.0), (99, 0.5)], "list_id long, score double")
    docs = spark.createDataFrame([(50, "t50", "t", "o50", "FILE"), (99, "t99", "t", "o", "API")], "list_id long, list_title string, title string, org_nm string, data_type string")
    found = {r["list_id"]: r for r in search_pages.found_listings(hits, docs, *tables).collect()}
    assert found[1]["token_count"] == 20 and found[1]["data_type"] == "API"
    assert found[50]["has_generated_doc"] and found[50]["list_title"] == "t50" and found[50]["org_nm"] == "o50"
    assert not found[99]["has_generated_doc"] and found[99]["org_nm"] is None  # only a generated API document
    assert rows(search_pages.documented_page(hits, docs, *tables, page=1, size=2), "list_id") == [(1,), (7,)]
    assert rows(search_pages.documented_page(hits, docs, *tables, page=3, size=1), "list_id") == []
    assert rows(search_pages.documented_page(hits, docs, *tables, page=2, size=2, overfetch=None), "list_id") == [(50,), (99,)]


def test_neighbours(spark):
    v = spark.createDataFrame([("a", "API", [1.0, 0.0]), ("b", "FILE", [1.0, 0.0]), ("c", None, [1.0, 1.7320508]), ("z", "API", [0.0, 0.0]), ("n", "API", None)], "doc_id string, doc_type string, vector array<float>")
    one = vectors.neighbours_of(v, ["a", "z", "missing"])
    assert rows(one, "target_doc_id", "doc_id", "rank")[0] == ("a", "b", 1)
    every = vectors.all_neighbours(v, threshold=0.1, block_rows=1)
    assert rows(every, "target_doc_id", "doc_id", "doc_type") == [("a", "b", "FILE"), ("a", "c", "API"), ("b", "a", "API"), ("b", "c", "API"), ("c", "a", "API"), ("c", "b", "FILE")]
    some = vectors.all_neighbours(v, threshold=0.1, targets=spark.createDataFrame([("c",), ("z",), ("no",)], "doc_id string"))
    assert rows(some, "target_doc_id", "doc_id") == [("c", "a"), ("c", "b")]
    for bad in (lambda: vectors.neighbours_of(v, [str(i) for i in range(101)]), lambda: vectors.neighbours_of(v, ["a"], top_k=21), lambda: vectors.all_neighbours(v, threshold=1.5)):
        with pytest.raises(ValueError):
            bad()


def test_upsert_counts_versions_and_empty_lists_miss(spark):
    empty = spark.createDataFrame([], recommendations.STORED)
    targets = spark.createDataFrame([("a", "API"), ("b", "API")], "target_doc_id string, target_doc_type string")
    found = spark.createDataFrame([("a", "x", "API", 0.9, 1), ("a", "y", "API", 0.8, 2)], "target_doc_id string, doc_id string, doc_type string, similarity_score double, rank int")
    new = recommendations.gathered(targets, found)
    once = recommendations.upsert(empty, new, as_of())
    twice = {r["target_doc_id"]: r for r in recommendations.upsert(once, new, as_of()).collect()}
    assert twice["a"]["version"] == 2 and [x["doc_id"] for x in twice["a"]["recommendations"]] == ["x", "y"] and twice["b"]["recommendations"] == []
    assert rows(recommendations.misses(targets, once), "target_doc_id") == [("b",)]
    assert rows(recommendations.cached(once, 1), "target_doc_id", "doc_id") == [("a", "x")]
    assert rows(recommendations.cached(once, 5, as_of() + F.expr("interval 8 days")), "doc_id") == []
    assert recommendations.to_store(new).count() == 1 and recommendations.remove(once, ["a"]).count() == 1
    assert recommendations.remove(once).count() == 0 and recommendations.failed(new).first()["failed"] == 1
    assert recommendations.cache_stats(once, targets, as_of()).first()["cache_hit_ratio"] == "50.00%"


def test_snapshots_and_requests(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert stores.last_version(spark, path) == 0
    assert stores.replace_snapshot(spark.range(3), path) and not stores.replace_snapshot(spark.range(0), path)
    assert stores.read_snapshot(spark, path).count() == 3
    assert stores.replace_snapshot(stores.read_snapshot(spark, path).where("id < 2"), path)
    assert stores.read_snapshot(spark, path).count() == 2 and stores.last_version(spark, path) == 2
    requests = str(tmp_path / "requests")
    stores.save_request(spark, requests, None, "u", T)
    stores.save_request(spark, requests, 4, None, T)
    assert rows(spark.read.parquet(requests).where("list_id is null"), "url", "created_at") == [("u", T + dt.timedelta(hours=9))]
    with pytest.raises(ValueError):
        stores.save_request(spark, requests, 0, "", T)


def test_versions_are_pruned_and_rows_removed(spark, tmp_path):
    path = str(tmp_path / "v")
    for n in (1, 2, 3, 4):
        stores.replace_snapshot(spark.range(n), path)
    assert stores.versions(spark, path) == [3, 4] and stores.read_snapshot(spark, path).count() == 4
    (tmp_path / "v" / "version=00000009").mkdir()  # a write that was lost
    assert stores.last_version(spark, path) == 4
    assert stores.replace_snapshot(spark.range(4), path) and stores.versions(spark, path) == [4, 10]  # writers go on after it, while it stays
    assert stores.upsert_snapshot(spark.range(3, 6), path, "id") == 3
    assert stores.remove_one(spark, path, "id", 0) and not stores.remove_one(spark, path, "id", 0)
    assert stores.remove_many(spark, path, "id", [1, 99]) == 2 and stores.remove_many(spark, path, "id", []) == 0
    assert rows(stores.read_snapshot(spark, path), "id") == [(2,), (3,), (4,), (5,)]


def test_catalog_tables(spark):
    name = "catalith_test_index"
    stores.delete_index(spark, name)
    assert stores.create_index(spark.range(2), name) and not stores.create_index(spark.range(5), name)
    assert stores.insert(spark.range(7, 8), name) == 1 and spark.table(name).count() == 3
    assert stores.create_index(spark.range(5), name, recreate=True) and spark.table(name).count() == 5
    assert stores.delete_index(spark, name) and not stores.delete_index(spark, name)


def test_shared_folder_is_asked_of_a_cluster():
    from types import SimpleNamespace

    Cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))

    with pytest.raises(ValueError, match="checkpoint"):
        stores.work_folder(Cluster)


def test_page_from_ranking_or_live(spark):
    snapshot = spark.createDataFrame([(1, "t", "o", None, None, "API", 1)], "list_id long, list_title string, org_nm string, token_count long, has_generated_doc boolean, data_type string, rank int")
    metadata = spark.createDataFrame([("popular", 7), ("latest", 0)], "sort_type string, total_count long")
    live = spark.range(1).withColumnRenamed("id", "list_id"), spark.createDataFrame([(9,)], "total long")
    of = lambda kind, page: [f.collect() for f in ranks.ranked_or_live(snapshot, metadata, kind, live, page)]
    inside, beyond = paging.clamp(1, 20), paging.clamp(51, 20)
    assert [(r[0]["list_id"], t[0]["total"]) for r, t in (of("popular", inside), of("popular", beyond), of("latest", beyond), of("none", inside))] == [(1, 7), (0, 7), (0, 9), (1, 0)]


def test_rankings_are_stored(spark, tables, tmp_path):
    counts = ingest.build_rankings(ranks.rank_rows(*tables), str(tmp_path), as_of())
    stored = stores.read_snapshot(spark, f"{tmp_path}/rank_popular")
    assert counts["popular"] == 6 and ranks.snapshot_page(stored, paging.clamp(1, 2)).count() == 2


def listed(spark, n, hot):
    """n rows of which hot share a key, with repeated ids and null keys."""
    c = F.col("id")
    score = F.when(c % 10 < hot, F.lit(5.0)).when(c % 10 == 9, F.lit(None)).otherwise((c * 7919 % 1000).cast("double"))
    kind = F.when(c % 2 == 0, "API").otherwise("FILE")
    return spark.range(n).select((c % (n // 2 + 1)).alias("list_id"), kind.alias("data_type"), F.concat(F.lit("t"), c).alias("list_title"), score.alias("popularity_score"))


@pytest.mark.parametrize(("n", "hot", "keep"), [(0, 0, 2000), (1, 9, 2000), (5000, 4, 2000), (5000, 10, 4999), (5000, 0, 5000), (3000, 3, 9000)])
def test_ranks_by_range_are_those_of_one_sort(spark, n, hot, keep):
    made = ranks.rank_popular(listed(spark, n, hot), keep)
    given = [r["popularity_score"] or 0.0 for r in listed(spark, n, hot).collect()]
    want = sorted(zip(given, listed(spark, n, hot).collect(), strict=True), key=lambda x: (-x[0], x[1]["list_id"], x[1]["data_type"], x[1]["list_title"]))[:keep]
    assert made.columns == ["list_id", "data_type", "list_title", "popularity_score", "rank"]
    assert rows(made, "rank", "list_title") == [(i, r["list_title"]) for i, (_, r) in enumerate(want, 1)]


def test_pages_of_a_stored_ranking_open_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FILE_ROWS", 500)
    flat = listed(spark, 5000, 4).withColumns({"org_nm": F.lit("o"), "token_count": F.lit(1), "has_generated_doc": F.lit(True)})
    stores.replace_snapshot(ranks.rank_popular(flat, 4000), str(tmp_path / "r"), order=("rank",))
    stored = stores.read_snapshot(spark, str(tmp_path / "r"))
    spans = sorted(tuple(r) for r in stored.groupBy(F.input_file_name().alias("f")).agg(F.min("rank").alias("a"), F.max("rank").alias("b")).select("a", "b").collect())
    assert len(spans) >= 8 and spans[0][0] == 1 and spans[-1][1] == 4000 and all(b + 1 == a for (_, b), (a, _) in zip(spans, spans[1:], strict=False))
    page = ranks.snapshot_page(stored, paging.clamp(3, 20))
    scan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rank,41)" in scan and "LessThanOrEqual(rank,60)" in scan
    assert [r["list_id"] for r in page.collect()] == [r["list_id"] for r in stored.where("rank between 41 and 60").orderBy("rank").collect()]


def test_scratch_tables_are_new_paths(spark):
    assert stores.scratch(spark, "x") != stores.scratch(spark, "x") and stores.scratch(spark, "x").startswith(stores.work_folder(spark))


def test_listing_ingest(tables):
    api, file = tables[:2]
    corpus = listings.recommendation_corpus(api, file, api_first=True)
    made = vectors.encode(corpus, vectors.hash_encoder(8), vectors.embedding_text())
    assert made.count() == 5 and len(made.first()["vector"]) == 8
    assert stats.success_rate(api, tables[2]).first()["success_rate"] == 100.0
    assert stats.coverage(api.limit(0), file, tables[2], tables[3]).first()["api_coverage"] == 0.0


def test_lookup_of_empty_tables(spark):
    left, right = spark.range(2).withColumnRenamed("id", "k"), spark.createDataFrame([], "k long, v int")
    assert rows(lookup.lookup_first(left, right, "k", ["v"]), "k", "v") == [(0, None), (1, None)]


def test_stream_of_requests_is_stored(spark, tmp_path):
    from catalith.streaming.requests import hourly_requests, store_requests

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, None, T), (None, "", T), (1, "u", T)], "list_id long, url string, at timestamp").write.parquet(source)
    stream = spark.readStream.schema("list_id long, url string, at timestamp").parquet(source)
    store_requests(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    query = hourly_requests(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("hourly"), "list_id", "n") == [(1, 2)]
