import math
import random
import zlib

import numpy as np

from catalith.llm import toxicity as op
from catalith.llm.queries import op3_toxicity


def brute_segments(x):
    """Maximal scoring segments by their definition: take the best (shortest, leftmost), split, repeat."""

    def take(a, b):
        best = max(((sum(x[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*take(a, i), (i, j, best[0]), *take(j, b)]

    return take(0, len(x))


def test_maximal_segments():
    r = random.Random(5)
    for _ in range(300):
        x = np.array([r.choice([-3, -2, -1, -1, 0, 1, 2, 4]) + r.random() / 64 for _ in range(r.randint(0, 14))])
        assert [(a, b) for a, b, _ in op.maximal_segments(x)] == [(a, b) for a, b, _ in brute_segments(list(x))]


def test_evidence_of_all_significant_segments():
    """The score of a text from its segments by definition, and every choice of the best r of them."""
    r = random.Random(8)
    model = op.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 0.9, -1.5, 0.8, -4.0)
    texts = [[r.choice([-3, -1, -1, 0, 2, 5]) + r.random() / 64 for _ in range(r.randint(0, 40))] for _ in range(60)] + [[6.0, 6.0, -30.0] * 5, []]
    row = np.cumsum([0, *map(len, texts)])
    evidence, found = op.significant(np.concatenate([np.array(x, float) for x in texts]), row, model)
    several = 0
    for x, e, got in zip(texts, evidence, found, strict=True):
        normalized = [0.9 * s + 1.5 - math.log(len(x)) for _, _, s in brute_segments(x)] or [1.5 - math.log(max(1, len(x)))]
        strong = sorted((s for s in normalized if s >= -math.log(0.01)), reverse=True)
        chances = [math.exp(-sum(strong[:k])) * sum(strong[:k]) ** (k - 1) / (math.factorial(k) * math.factorial(k - 1)) for k in range(1, len(strong) + 1)]
        assert math.isclose(e, -math.log(min(chances)) if strong else max(normalized), abs_tol=1e-9)
        assert len(got) == len(strong)
        several += len(strong) > 1
    assert several >= 5


def test_cases(docs, doc_rows, spark, no_docs):
    labels = spark.createDataFrame([(10, 1, 1), (3, 0, 0), (13, 1, None), (None, 1, 1), (12, 1, 1), (21, 0, 0)], "doc_id long, quality int, toxic int")
    got = op.score_toxicity(docs, labels, passages=True).collect()
    assert len(got) == len(doc_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    none = labels.limit(0)
    assert all(r["predicted"] == 0 for r in op.score_toxicity(docs, none).collect())
    assert op.score_toxicity(no_docs, none).collect() == []
    assert op.mark_toxic(docs, none).count() == len(doc_rows)
    clash = op.mark_toxic(docs.withColumn("_toxic", docs["n"]), labels)
    assert clash.columns[-2:] == ["_toxic", "__toxic"]
    by_score = {r["doc_id"]: r["predicted"] == 1 for r in got}
    assert all(r["_toxic"] == 7 and r["__toxic"] == by_score[r["doc_id"]] for r in clash.where("doc_id is not null").collect())


def test_held_out_accuracy_and_passages(spark):
    sf = "/root/testdata/sf0.1"
    scores = {r["doc_id"]: r for r in op3_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if scores[r["doc_id"]]["held_out"]]
    hits = [scores[r["doc_id"]]["predicted"] for r in labels if r["toxic"]]
    false = [scores[r["doc_id"]]["predicted"] for r in labels if not r["toxic"]]
    assert sum(hits) > 0.85 * len(hits)
    assert sum(false) < 0.01 * len(false)
    caught = [scores[r["doc_id"]]["n_passages"] > 0 for r in labels if r["toxic"] and scores[r["doc_id"]]["predicted"]]
    assert sum(caught) > 0.9 * len(caught)
