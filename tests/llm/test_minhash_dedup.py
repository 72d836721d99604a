import random
import re
from collections import Counter

import pytest

from catalith.llm import minhash_dedup as op
from catalith.llm.queries import op8_minhash_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words=3, percent=85):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[a : a + words]) for a in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None and sets[i]]
    for i in ids:
        for j in ids:
            if j < i:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return Counter((i, len(sets[i]), None if i is None else find(i), i is None or find(i) == i) for i, _ in rows)


def unique_null(rows):
    """Rows whose null doc_ids keep their own texts apart."""
    return [r[:2] for r in rows if r[0] is not None]


def test_all_cases(docs, doc_rows):
    got = op.near_duplicates(docs).collect()
    assert Counter(map(tuple, (r for r in got if r["doc_id"] is not None))) == brute(unique_null(doc_rows))
    assert sorted((r["component_id"], r["kept"]) for r in got if r["doc_id"] is None) == [(None, True)] * 2


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_chains_of_edits(spark, words, percent):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):  # copies of copies, so that links form chains around the threshold
        text = r.choices(vocabulary, k=r.choice([4, 9, 30, 120, 300]))
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            for _ in range(r.randint(0, max(1, len(text) // 40))):
                text[r.randrange(len(text))] = r.choice(vocabulary)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, op.near_duplicates(df, words, percent).collect())) == brute(rows, words, percent)


def test_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(r.randint(2, 5)):
            text[r.randrange(200)] = f"x{r.random()}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, op.near_duplicates(df).collect())) == brute(rows)


def test_strangers_that_own_the_buckets(spark):
    r = random.Random(5)
    passages = [[f"w{i}_{j}" for j in range(15)] for i in range(20)]
    rows = []
    for i in range(400):  # each has some passages of the similar pair in their order, and words of its own
        mine = set(r.sample(range(20), 13))
        rows.append((i, " ".join(w for j, p in enumerate(passages) for w in (p if j in mine else [f"s{i}_{j}_{k}" for k in range(15)]))))
    text = [w for p in passages for w in p]
    rows.append((1000, " ".join(text)))
    for j in range(30, 270, 40):
        text[j] = "edited"
    rows.append((1001, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, op.near_duplicates(df).collect()))
    assert got == brute(rows)
    assert got[(1001, 298, 1000, False)] == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 200), (300, 299)]
    got = {r["id"]: r["component"] for r in op.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {**{i: 0 for i in [*range(41), 200]}, **{i: 100 for i in range(100, 130)}, 299: 299, 300: 299}
    assert {**{i: i for i in (0, 100, 299)}, **got} == want


def test_empty(no_docs):
    assert op.near_duplicates(no_docs).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op8_minhash_dedup(spark, sf).collect())) == brute(rows)
