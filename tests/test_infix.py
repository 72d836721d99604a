import random

import pytest

from catalith.operators import infix


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    some = ["".join(r.choice("abcAB é한🙂.") for _ in range(r.randint(0, 25))) for _ in range(200)]
    return dict(enumerate([None, "", "x", "xy", "Straße", "aaaa", *some, "a" * 5000 + "needle"]))


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("grams"))
    docs = spark.createDataFrame([*texts.items(), (None, "no id")], "list_id long, text string")
    infix.write_gram_index(docs, folder)
    return infix.read_gram_index(spark, folder)


def test_grams(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(texts.items()), "i long, t string").select("i", infix.text_grams(F.col("t")).alias("g")).collect()
    for r in rows:
        t = (texts[r["i"]] or "").lower()
        assert set(r["g"] or []) == {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} and len(set(r["g"] or [])) == len(r["g"] or [])


def test_parts_against_every_text(index, texts):
    for part in ["a", "AB", "abc", "b é", "한🙂", "🙂", "aaaa", "needle", "ANEEDLE", "nowhere", "é한🙂.", "", "%", ".", "xy", "ß"]:
        got = {r["list_id"] for r in infix.infix_search(index, part).collect()}
        assert got == {i for i, t in texts.items() if part and t and part.lower() in t.lower()}, part


def test_many_found_are_joined(index, texts, monkeypatch):
    monkeypatch.setattr(infix, "MAX_LITERALS", 2)
    got = {r["list_id"]: r["text"] for r in infix.infix_search(index, "ab").collect()}
    assert got == {i: t for i, t in texts.items() if t and "ab" in t.lower()}


def test_no_request_scans_the_texts(index):
    plan = infix.infix_search(index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "/docs" in plan and ("In(list_id" in plan or "EqualTo(list_id" in plan)
    plan = infix.candidates(index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan and "/docs" not in plan


def test_rarest_first(index):
    assert infix.candidates(index, "aneedle").count() == 1
    assert infix.asked_grams("abcab") == ["abc", "bca", "cab"] and infix.asked_grams("ab") == ["ab"] and infix.asked_grams("") == []


def test_empty(spark, tmp_path):
    infix.write_gram_index(spark.createDataFrame([], "list_id long, text string"), str(tmp_path))
    assert infix.infix_search(infix.read_gram_index(spark, str(tmp_path)), "a").collect() == []


def test_grams_are_made_in_tasks_of_bounded_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(infix, "TASK_CHARS", 1000)
    texts = {i: f"https://example.org/{i:04d}" for i in range(400)}
    infix.write_gram_index(spark.createDataFrame([*texts.items()], "list_id long, text string").coalesce(1), str(tmp_path))
    index = infix.read_gram_index(spark, str(tmp_path))
    files = index.grams.selectExpr("_metadata.file_path AS file", "list_id", "gram").groupBy("file").agg({"list_id": "min", "*": "count"}).collect()
    assert len(files) > 5 and len({r["min(list_id)"] for r in files}) == len(files) and max(r["count(1)"] for r in files) < index.grams.count() / 4
    assert {r["list_id"] for r in infix.infix_search(index, "g/012").collect()} == {i for i in texts if i // 10 == 12}
