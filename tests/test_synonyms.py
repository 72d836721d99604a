"""Search with synonyms against all readings of a request."""

import math
import random

import pytest

from catalith.operators import search, synonyms

GROUPS = [["a", "d"], ["a b", "c", "e f g"], ["b c", "d d"], ["", "x"], ["q q", "b"]]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    made = [" ".join(r.choice("abcdefgq") for _ in range(r.randint(0, 12))) for _ in range(300)]
    return dict(enumerate([None, "", "...", "a", "c", "d d d d", "e f g c", "A, B. C", *made, "z " * 4000 + "e f g c " * 3]))


@pytest.fixture(scope="module")
def index(spark, texts):
    docs = spark.createDataFrame([*((i, t, t) for i, t in texts.items()), (None, "a b", "a")], "list_id long, desc string, title string")
    found = search.build_index(docs, {"desc": "desc", "title": "title"}, {})
    found.postings.persist()
    return found


def terms_of(text):
    return [w for w in (text or "").lower().replace(".", " ").replace(",", " ").split() if w]


def readings(terms, rules):
    """Every sequence that the request stands for."""
    if not terms:
        return {()}
    out = {(terms[0], *rest) for rest in readings(terms[1:], rules)}
    for group in rules:
        for p in group:
            if p and tuple(terms[: len(p)]) == p:
                out |= {(*q, *rest) for q in group if q for rest in readings(terms[len(p) :], rules)}
    return out


def starts(text, wanted):
    words = terms_of(text)
    return {i for i in range(len(words)) for r in wanted if tuple(words[i : i + len(r)]) == r}


RULES = [[tuple(p.split()) for p in g] for g in GROUPS]


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "c", "b c a", "a a b b", "q q c", "z", "b q q", "E f G", "nowhere", "nowhere a", "", "..."])
def test_phrases_against_every_reading(index, texts, text):
    met, many = synonyms.matched(index, text, ["desc"], GROUPS)
    wanted = readings(terms_of(text), RULES)
    want = {i: len(starts(t, wanted)) for i, t in texts.items() if terms_of(text) and starts(t, wanted)}
    assert {r["list_id"]: r["tf"] for r in met.collect()} == want and many == {"desc": int(bool(terms_of(text)))}


def test_graph_nodes_ascend_and_spans_keep_what_follows():
    graph = synonyms.token_graph(["a", "b", "z"], RULES)
    assert all(a < b for a, b, _ in graph.edges) and max(b for _, b, _ in graph.edges) == graph.end
    last = {a for a, b, t in graph.edges if t == "z"}
    assert {b for _, b, t in graph.edges if t in ("b", "c", "g", "q")} >= last and len(last) == 1
    assert synonyms.token_graph([], RULES) == synonyms.TokenGraph((), -1)


def test_units_are_longest_phrases():
    assert synonyms.units(list("abcqqx"), RULES) == [["a", "b"], ["c"], ["q", "q"], ["x"]]
    assert synonyms.units(["a", "b"], []) == [["a"], ["b"]] and synonyms.units([], RULES) == []


@pytest.mark.parametrize(("text", "phrase", "every"), [("a b c", True, False), ("a b c q", False, False), ("q q c", False, True), ("...", False, True)])
def test_scores(index, texts, text, phrase, every):
    fields = {"desc": 1.0, "title": 2.0}
    got = {r["list_id"]: r["score"] for r in synonyms.synonym_scores(index, text, fields, GROUPS, phrase, every).collect()}
    parts = [terms_of(text)] if phrase else synonyms.units(terms_of(text), RULES)
    long = {i: len(terms_of(t)) for i, t in texts.items() if terms_of(t)}
    mean, want = sum(long.values()) / len(long), {}
    found = [{i: len(starts(texts[i], readings(p, RULES))) for i in long} for p in parts if p]
    for f in found:
        n = sum(v > 0 for v in f.values())
        idf = math.log(1 + (len(long) - n + 0.5) / (n + 0.5))
        for i, tf in f.items():
            if tf and (not every or all(g[i] for g in found)):
                want[i] = want.get(i, 0.0) + 2.0 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * long[i] / mean))  # both fields are alike, the larger boost counts
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_many_terms_are_joined(index, texts, monkeypatch):
    want = sorted(synonyms.matched(index, "a b c", ["desc"], GROUPS)[0].collect())
    monkeypatch.setattr(search, "MAX_LITERALS", 1)
    assert sorted(synonyms.matched(index, "a b c", ["desc"], GROUPS)[0].collect()) == want


def test_english_fields_read_synonyms_as_they_are_stored(spark):
    from catalith.functions import text as analyzers

    docs = spark.createDataFrame([(1, "running cars fast"), (2, "automobiles running"), (3, "the motor vehicle is running")], "list_id long, title string")
    index = search.build_index(docs, {"title": "title"}, {"title": analyzers.english})
    met, _ = synonyms.matched(index, "runs the car", ["title"], [["car", "automobile", "motor vehicle"]])
    assert {r["list_id"] for r in met.collect()} == {1}
    met, _ = synonyms.matched(index, "vehicle cars", ["title"], [["vehicle cars", "motor vehicle run", "automobile running"]])
    assert {r["list_id"] for r in met.collect()} == {2, 3}


def test_empty_index(spark):
    index = search.build_index(spark.createDataFrame([], "list_id long, desc string"), {"desc": "desc"}, {})
    assert synonyms.synonym_scores(index, "a b", {"desc": 1.0}, GROUPS).collect() == []
