"""Stored indexes: deletion postings against brute force, segments against an index built at once, writes that are lost."""

import random

import pytest
from pyspark.sql import functions as F

from catalith.functions import text
from catalith.operators import search
from catalith.sources import segments

FIELDS = {"list_title": "list_title", "desc": "desc"}
SCHEMA = "list_id long, list_title string, desc string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def vocabulary(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé한") for _ in range(r.randint(1, 14))) for _ in range(n)]
    edited = []
    for w in base:
        for _ in range(3):
            x = list(w)
            for _ in range(r.randint(1, 3)):
                i = r.randrange(len(x) + 1)
                x[i : i + r.randint(0, 1)] = r.choice(["", "a", "b", "x"])
            edited.append("".join(x) or "a")
    return sorted({*base, *edited})


def test_near_terms_are_all_within_their_edits(spark):
    words = vocabulary(60, 3)
    docs = spark.createDataFrame([(i, w, None) for i, w in enumerate(words)], SCHEMA)
    index = search.build_index(docs, FIELDS, {"list_title": text.keyword})
    asked = [(w, e) for w in [*words[::7], "", "zzz"] for e in (1, 2)]
    found = {(r["asked"], r["edits"], r["term"]) for r in search.near_terms(index, asked).collect()}
    assert found == {(a, e, w) for a, e in asked for w in words if levenshtein(a, w) <= e}
    assert len(found) > 150
    with pytest.raises(ValueError):
        search.near_terms(index, [("a", 3)])


def test_keys_of_a_term_are_few(spark):
    long = spark.createDataFrame([("abcdefghijklmnop" * 500,), ("ab",)], "term string")
    n = {len(r["term"]): r["n"] for r in search.deletion_postings(long).groupBy("term").agg(F.count_distinct("key").alias("n")).collect()}
    assert n[8000] == 37 and n[2] == 4  # ab, a, b and nothing
    some = spark.createDataFrame([(w,) for w in ("", "a", "aa", "abc", "éa한bcd", "abcdefgh")], "term string")
    for r in search.deletion_postings(some).groupBy("term").agg(F.collect_set("key").alias("keys")).collect():
        assert set(r["keys"]) == text.left_by_deletions(r["term"], search.MAX_EDITS)


def test_fuzzy_search_reads_keys_not_the_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([(i, w, w[::-1]) for i, w in enumerate(vocabulary(40, 5))], SCHEMA)
    segments.upsert(docs, str(tmp_path), FIELDS)
    index = segments.read_index(spark, str(tmp_path))
    plan = search.near_terms(index, [("abba", 1)])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key, [" in plan.replace("IsNotNull(key), ", "") and "/terms" not in plan


def same(spark, folder, docs):
    """The stored index and one built at once from docs: counts, lengths, tokens and scores."""
    stored, fresh = segments.read_index(spark, folder), search.build_index(docs, FIELDS)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(stored.tokens, "list_id", "field", "len", "pos", "term") == rows(fresh.tokens, "list_id", "field", "len", "pos", "term")
    assert rows(stored.terms, "field", "term", "n") == rows(fresh.terms, "field", "term", "n")
    assert rows(stored.fields, "field", "docs", "mean_len") == rows(fresh.fields, "field", "docs", "mean_len")
    assert rows(segments.read_docs(spark, folder), "list_id", "list_title", "desc") == rows(docs, "list_id", "list_title", "desc")
    score = lambda index: {r["list_id"]: round(r["score"], 9) for r in search.search_titles(index, "red rings").collect()}
    assert score(stored) == score(fresh)
    pages = lambda index: [(r["list_id"], round(r["score"], 9)) for r in search.top_hits(index, search.weighted_clauses(["red ring", "box"], [1.0, 3.0]), 4, 1).collect()]
    assert pages(stored) == pages(fresh)


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


def test_upserts_removals_and_merges_are_one_index(spark, tmp_path):
    folder, r = str(tmp_path), random.Random(1)
    words = ["red", "ring", "rings", "blue", "box", "reed", "old"]
    text_of = lambda: r.choice([None, "", *(" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(5))])
    now = {i: (text_of(), text_of()) for i in range(30)}
    assert segments.upsert(frame(spark, now), folder, FIELDS) == 30
    for step in range(2):
        change = {i: (text_of(), text_of()) for i in r.sample(range(40), 3)}
        assert segments.upsert(frame(spark, change), folder, FIELDS) == 3
        now |= change
        if step == 1:
            segments.remove(spark, folder, [0, 1, 999], FIELDS)
            now = {k: v for k, v in now.items() if k not in (0, 1)}
    assert len(segments.manifest(spark, folder)) == 4
    same(spark, folder, frame(spark, now))
    assert segments.merge(spark, folder, most=3)
    assert [n for _, n in segments.manifest(spark, folder)][0] == 30 and len(segments.manifest(spark, folder)) == 2  # the large one stays
    same(spark, folder, frame(spark, now))
    assert segments.merge(spark, folder, most=1) and not segments.merge(spark, folder, most=1)
    same(spark, folder, frame(spark, now))
    held = {p.name for p in (tmp_path / "segments").iterdir()}
    assert len(held) == 3  # of this manifest and the one before it
    assert segments.upsert(frame(spark, now).limit(0), folder, FIELDS) == 0 and len(segments.manifest(spark, folder)) == 1
    one = {5: ("only", "this")}
    assert segments.upsert(frame(spark, one), folder, FIELDS, recreate=True) == 1
    same(spark, folder, frame(spark, one))
    assert segments.upsert(spark.createDataFrame([(None, "no", "id")], SCHEMA), folder, FIELDS) == 0


def test_an_upsert_writes_in_proportion(spark, tmp_path):
    folder = str(tmp_path)
    many = spark.range(3000).select(F.col("id").alias("list_id"), F.concat(F.lit("title "), F.col("id")).alias("list_title"), F.sha2(F.col("id").cast("string"), 256).alias("desc"))
    segments.upsert(many, folder, FIELDS)
    before = {r["part"]: r["bytes"] for r in segments.sizes(spark, folder).collect()}
    segments.upsert(frame(spark, {1: ("new", "one"), -1: ("new", "two"), 2: ("x", None)}), folder, FIELDS)
    after = {r["part"]: (r["bytes"], r["segments"]) for r in segments.sizes(spark, folder).collect()}
    assert all(after[k][1] == 2 for k in before)
    assert sum(after[k][0] - before[k] for k in before) < sum(before.values()) / 10


@pytest.mark.parametrize("table", ["docs", "terms", "impacts"])
def test_a_write_lost_between_tables_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch, table):
    folder, now = str(tmp_path), {1: ("red ring", "a"), 2: ("blue box", "b")}
    segments.upsert(frame(spark, now), folder, FIELDS)
    real = segments.write_table

    def lost(df, path, *x):
        if path.endswith(f"/{table}"):
            raise OSError("lost")
        real(df, path, *x)

    monkeypatch.setattr(segments, "write_table", lost)
    with pytest.raises(OSError, match="lost"):
        segments.upsert(frame(spark, {2: ("red", None), 3: ("ring", None)}), folder, FIELDS)
    same(spark, folder, frame(spark, now))
    monkeypatch.setattr(segments, "write_table", real)
    change = {2: ("red rings", None), 3: ("ring", "c")}
    assert segments.upsert(frame(spark, change), folder, FIELDS) == 2  # what is left of the lost write is in nobody's way
    same(spark, folder, frame(spark, now | change))


def test_a_second_writer_is_noticed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    segments.upsert(frame(spark, {1: ("a", "b")}), folder, FIELDS)
    seen = segments.manifest(spark, folder)
    segments.upsert(frame(spark, {2: ("c", "d")}), folder, FIELDS)
    with pytest.raises(RuntimeError, match="another writer"):
        segments.commit(spark, folder, seen, seen)


def many_docs(spark, n=3000):
    """Common words everywhere, rare ones in few ranges, and documents that are equal, so that scores tie."""
    r = random.Random(9)
    rows = []
    for i in range(n):
        words = ["the", "and"] * r.randint(0, 3) + [r.choice("abcdefgh") for _ in range(r.randint(1, 6))]
        if i % 400 < 3:
            words += ["rare"] * (i % 3 + 1) + ["gem"]
        r.shuffle(words)
        rows.append((i * 3 - 900, " ".join(words), "the rare gem" if i % 700 == 5 else None))
    return spark.createDataFrame([*rows, *((10_000 + i, "the rare and", None) for i in range(30))], SCHEMA)


def test_pages_from_ranges_are_those_of_all_scores(spark, tmp_path):
    segments.upsert(many_docs(spark), str(tmp_path), FIELDS)
    index = segments.read_index(spark, str(tmp_path))
    two = {"list_title": 2.0, "desc": 1.0}
    requests = [
        [search.Clause("the rare", two), search.Clause("and gem", {"list_title": 1.0}, boost=3.0)],
        [search.Clause("rare gem", two, phrase=True), search.Clause("the and", two)],
        [search.Clause("the raer gem", two, all_terms=True, edits=1), search.Clause("a b", two, phrase=True)],
        [search.Clause("missing", two)],
    ]
    for clauses in requests:
        every = search.clause_scores(index, clauses)
        for size, offset in ((10, 15), (4000, 0)):
            want = [(r["list_id"], round(r["score"], 9)) for r in search.top(every, size, offset).collect()]
            assert [(r["list_id"], round(r["score"], 9)) for r in search.top_hits(index, clauses, size, offset).collect()] == want


def test_ranges_are_left_out(spark, tmp_path, monkeypatch):
    segments.upsert(many_docs(spark), str(tmp_path), FIELDS)
    index = segments.read_index(spark, str(tmp_path))
    clauses = [search.Clause("the rare gem", {"list_title": 1.0})]
    every = index.tokens.select(search.range_of(F.col("list_id")).alias("r")).distinct().count()
    _, few, first = search.open_ranges(index, clauses, 10)
    assert first < 10 and len(few) < every / 2
    want = search.top_hits(index, clauses, 10).collect()
    monkeypatch.setattr(search, "MAX_LITERALS", 3)
    assert isinstance(search.open_ranges(index, clauses, 10)[1], type(index.tokens)) and search.top_hits(index, clauses, 10).collect() == want


def test_postings_are_the_places_of_each_term(spark):
    """Against brute force: null, empty and very long texts, one term again and again, an array of texts; made without a shuffle."""
    r = random.Random(4)
    long = " ".join(r.choice(["a", "b", f"w{r.randrange(500)}", "한"]) for _ in range(60_000))
    rows = [(1, "b a b", ["x y", None, "x"]), (2, None, None), (3, "", []), (4, "a " * 50, ["", "z"]), (5, long, None), (None, "a", ["a"])]
    index = search.build_index(spark.createDataFrame(rows, "list_id long, list_title string, desc array<string>"), FIELDS)
    want = {}
    for list_id, title, desc in rows:
        for name, words in (("list_title", (title or "").split()), ("desc", " ".join(x or "" for x in desc or []).split())):
            for i, w in enumerate(words if list_id else []):
                want.setdefault((list_id, name, len(words), w), []).append(i)
    got = index.postings.collect()
    assert {(p["list_id"], p["field"], p["len"], p["term"]): p["at"] for p in got} == want and len(got) == len(want)
    assert all(p["tf"] == len(p["at"]) for p in got)
    assert {(t["field"], t["docs"], t["total"]) for t in search.field_totals(index.postings).collect()} == {("list_title", 3, 60_053), ("desc", 2, 4)}
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_bounds_hold(spark):
    index = search.build_index(many_docs(spark, 500), FIELDS)
    clauses = [search.Clause("the rare gem", {"list_title": 1.0, "desc": 2.0}), search.Clause("rare gem", {"list_title": 1.0}, phrase=True)]
    bounds = {r["range"]: r["score"] for r in search.range_bounds(search._request(index, clauses), index.impacts).collect()}
    scores = search.clause_scores(index, clauses).withColumn("range", search.range_of(F.col("list_id"))).collect()
    assert scores and all(r["score"] <= bounds[r["range"]] + 1e-9 for r in scores)
