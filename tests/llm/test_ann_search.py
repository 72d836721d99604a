import numpy as np
import pytest

from catalith.llm import ann_search as op
from catalith.llm.queries import op4_ann_search


def brute(rows, asked, k=10):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for i, q in asked:
        d = np.sqrt(((v - np.array(q)) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_and_scores(spark, monkeypatch):
    for size in (op.VECTORS_IN_BLOCK, 300):
        monkeypatch.setattr(op, "VECTORS_IN_BLOCK", size)
        sf = "/root/testdata/sf0.1"
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want = brute(rows, [(i, q) for i, q in rows if i % 100 == 0])
        got = op4_ann_search(spark, sf).collect()
        assert len(got) == 10 * len(want)
        v = dict(rows)
        hits = 0
        for r in got:
            assert r["score"] == np.sqrt(((np.array(v[r["vec_id"]]) - np.array(v[r["query_id"]])) ** 2).sum())
            hits += r["vec_id"] in {i for i, _ in want[r["query_id"]]}
        assert hits >= 0.95 * len(got)


@pytest.mark.parametrize(("dim", "spread"), [(64, 1.0), (256, 1.0), (64, 0.1)])
def test_a_full_block(dim, spread):
    """Recall of a block of production size, without structure and in clusters; where neighbours are near, few vectors are verified."""
    r = np.random.default_rng(7)
    v = r.standard_normal((80, dim))[r.integers(0, 80, op.VECTORS_IN_BLOCK)] * (spread < 1) * 3 + r.standard_normal((op.VECTORS_IN_BLOCK, dim)) * spread
    own = np.arange(0, len(v), 200)
    index = op.SortedLines(np.arange(len(v)), v)
    got = index.search(v[own], own, 10)
    want = brute(list(enumerate(v)), [(int(i), v[i]) for i in own])
    hits = sum(len({i for i, _ in want[int(q)]} & set(ids.tolist())) for q, (ids, _) in zip(own, got, strict=True))
    assert hits >= 0.95 * 10 * len(own)
    assert spread == 1 or index.verified < 0.05 * len(v) * len(own)


def test_cases(spark):
    good = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (200, [5.0, 5.0]), (100, [1.0, 0.0])]
    bad = [(4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (300, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in op.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    want = brute([r for r in good[:5]], [good[0], good[4]])
    assert [(q, i) for q, _, i, _ in got] == [(q, i) for q in (100, 200) for i, _ in want[q]]
    assert [r for _, r, _, _ in got] == [1, 2, 3, 4] * 2
    assert [s for *_, s in got] == [d for q in (100, 200) for _, d in want[q]]
    assert op.nearest(df.limit(0), df).collect() == []
    assert op.nearest(df, df.limit(0)).collect() == []
