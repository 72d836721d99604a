import hashlib
import re

from catalith.llm import substring_dedup as op
from catalith.llm.queries import op1_substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=50):
    first = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if i is not None and (k not in first or i < first[k]):
                first[k] = i
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_all_cases(docs, doc_rows):
    got = sorted(map(tuple, op.digest(op.substring_dedup(docs)).collect()), key=repr)
    want = brute([r[:2] for r in doc_rows])
    assert got == want
    assert sum(r[2] for r in want) > 700


def test_other_columns_and_unchanged_text(docs, doc_rows):
    out = op.substring_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    texts = {r["doc_id"]: (r["text"], r["_n_removed"]) for r in out.collect() if r["doc_id"] is not None}
    for r in doc_rows:
        if r[0] is not None and not texts[r[0]][1]:
            assert texts[r[0]][0] == r[1]


def test_small_windows(docs, doc_rows):
    rows = [r for r in doc_rows if r[0] not in (22,)]
    small = docs.where("doc_id is null or doc_id <> 22")
    for window in (3, 20):
        assert sorted(map(tuple, op.digest(op.substring_dedup(small, window)).collect()), key=repr) == brute([r[:2] for r in rows], window)


def test_second_copy_in_the_document_of_the_first(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = []
    for n in (52, 60, 90):
        a, b, x, y, z = (words(f"{name}{n}_", n if name == "x" else 70) for name in "abxyz")
        rows += [(10 * n, " ".join([a, x, b])), (10 * n + 1, " ".join([y, x, z, y, x, z])), (10 * n + 2, " ".join([y, x, z]))]
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, op.digest(op.substring_dedup(df)).collect()), key=repr) == brute(rows)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    words = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, words), (2, words + " tail"), (None, words)], "doc_id long, text string")
    clash = df.withColumns({k: F.lit("mine") for k in ("_of", "_spans", "_n_words", "_runs", "m", "path")})
    got = {r["doc_id"]: (r["text"], r["_spans"], r["_n_words"], r["__n_words"], r["_n_removed"]) for r in op.substring_dedup(clash).collect()}
    assert got == {1: (words, "mine", "mine", 80, 0), 2: ("tail", "mine", "mine", 81, 80), None: (words, "mine", "mine", 80, 0)}


def test_empty(no_docs):
    assert op.digest(op.substring_dedup(no_docs)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op1_substring_dedup(spark, sf).collect()), key=repr) == brute(rows)
