import hashlib
import random
from collections import Counter

import pytest

from catalith.llm import line_dedup as op
from catalith.llm.common import SLICE_BYTES
from catalith.llm.queries import op5_line_dedup


def lines_of(text):
    return [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]


def brute(rows, k=2, words=50):
    lines = {i: lines_of(text) for i, text in rows if i is not None}
    first = {}
    for d in {1, k}:
        for i in sorted(lines):
            for a in range(len(lines[i]) - d + 1):
                first.setdefault(tuple(lines[i][a : a + d]), (i, a))
    out = []
    for i, text in rows:
        kept, at, gone = "", 0, set()
        own = lines.get(i, lines_of(text))
        for d in {1, k} if i is not None else ():
            for a in range(len(own) - d + 1):
                if (d == k or len(own[a].split()) >= words) and first[tuple(own[a : a + d])] < (i, a):
                    gone |= set(range(a, a + d))
        parts = (text or "").split("\n")
        for n, line in enumerate(parts):
            if line.strip(" \t\r\x0b\x0c"):
                at += 1
                if at - 1 in gone:
                    continue
            kept += line + ("\n" if n < len(parts) - 1 else "")
        out.append((i, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_all_cases(docs, doc_rows):
    assert rows_of(op.digest(op.line_dedup(docs))) == brute([r[:2] for r in doc_rows])


def prefix(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_order_and_common_prefixes(spark, seed):
    r = random.Random(seed)
    docs = {i: [r.choice("abcd"[: 2 + seed]) for _ in range(r.randint(0, 9))] for i in range(12)}
    docs |= {50: docs[3] + docs[4], 51: docs[3] + docs[4], 52: ["q", "a", "a"], 53: [f"l{i}" for i in range(70)], 54: ["b", *(f"l{i}" for i in range(70)), "a"]}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string").repartition(5)
    lines = op.sequences(df)
    array = op.neighbours(op.suffix_array(lines), (1, 2)).orderBy("rank", "doc_id", "pos").collect()
    # the alphabet's order is that of the hashes, so the order of lines is read from the array itself
    order = {}
    for row in array:
        order.setdefault(docs[row["doc_id"]][row["pos"]], len(order))
    many = Counter(x for d in docs.values() for x in d)
    want = sorted(([order[x] for x in d[p:] if x in order], i, p) for i, d in docs.items() for p in range(len(d)) if many[d[p]] > 1)
    assert all(many[x] > 1 for d in docs.values() for x in d if x != "q")
    assert {(i, p) for _, i, p in want} == {(row["doc_id"], row["pos"]) for row in array}
    real = [(row["doc_id"], row["pos"]) for row in array]
    assert [x for x in real if x[0] != 52] == [(i, p) for _, i, p in want if i != 52]  # q has no place in order
    assert [(row["p_doc"], row["p_pos"]) for row in array] == [(None, None), *real[:-1]]
    lcp = {(x["doc_id"], x["pos"]): x["lcp"] for x in op.common_prefixes(lines, op.neighbours(op.suffix_array(lines), (1, 2))).collect()}
    for (i, p), (j, q) in zip(real[1:], real, strict=False):
        assert lcp[i, p] == prefix(docs[i][p:], docs[j][q:])
    for d in (1, 2):
        named = {}
        for row in array:
            if len(docs[row["doc_id"]]) - row["pos"] >= d:
                named.setdefault(row[f"in_{d}"], set()).add(tuple(docs[row["doc_id"]][row["pos"] : row["pos"] + d]))
        assert all(len(x) == 1 for x in named.values())
        assert len(named) == len(set().union(*named.values()))


@pytest.mark.parametrize("k", [1, 2, 4])
def test_runs(spark, k):
    rows = [(1, "a\nb\n\nc\nd"), (2, "x\nb\nc\n \nd\ny"), (3, "a\na\na\na\na"), (4, "d"), (5, "q\na\nb"), (6, "a\nb\nc\nd\n"), (7, "\n\n"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = op.line_dedup(df, k)
    assert rows_of(op.digest(out)) == brute(rows, k)
    longest = {r["doc_id"]: r["_longest_match"] for r in out.collect()}
    assert longest == {1: 4, 2: 3, 3: 4, 4: 1, 5: 2, 6: 4, 7: 0, 8: 0}


def test_long_lines(spark):
    long, short = " ".join(["w"] * 50), " ".join(["w"] * 49)
    rows = [(2, f"a\n{long}\nb"), (1, long), (3, f"{long}"), (4, f"c\n{short}\nd"), (5, short), (6, f"e\n{long}\n{long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(op.digest(op.line_dedup(df))) == brute(rows)
    assert {r["doc_id"]: r["text"] for r in op.line_dedup(df).collect()} == {1: long, 2: "a\nb", 3: "", 4: f"c\n{short}\nd", 5: short, 6: "e\n"}


def test_clashing_names_and_one_text_over_a_slice(spark):
    from pyspark.sql import functions as F

    long = "\n".join(f"line {i % 40_000}" for i in range(100_000))
    assert len(long) > SLICE_BYTES
    rows = [(1, long), (2, "line 7\nline 8\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumns({k: F.lit("mine") for k in ("_of", "_at", "_longest_match", "_n_lines", "lcp", "rank", "names")})
    out = op.line_dedup(clash)
    assert {r["doc_id"]: r["_at"] for r in out.collect()} == {1: "mine", 2: "mine"}
    assert rows_of(op.digest(op.line_dedup(df))) == brute(rows)
    assert {r["doc_id"]: r["__longest_match"] for r in out.collect()} == {1: 60_000, 2: 2}


def test_rejects(docs):
    with pytest.raises(ValueError, match="power of two"):
        op.line_dedup(docs, 3)


def test_empty(no_docs):
    assert op.digest(op.line_dedup(no_docs)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op5_line_dedup(spark, sf)) == brute(rows)
