import re
from collections import Counter

import numpy as np
import pyarrow as pa

from catalith.llm import quality_rules as op
from catalith.llm.common import Words
from catalith.llm.queries import op10_quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    again = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 8)}
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again))
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def test_counts(docs, doc_rows, spark):
    labels = spark.createDataFrame([(3, 1, 0), (13, 1, 0), (10, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = op.quality_rules(docs, labels).collect()
    assert Counter((r["doc_id"], *(r[k] for k in op.COUNTS), r["base_failed"]) for r in got) == Counter((r[0], *brute(r[1])) for r in doc_rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_ratio_and_threshold(docs, doc_rows, spark):
    """Multinomials, weights, ratios and the threshold, gram by gram; only the hash of a gram is the operator's."""
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")

    def grams(text):
        words = token.findall((text or "").encode())
        return [(x,) for x in words] + list(zip(words, words[1:], strict=False))

    def bucket(gram):  # the words of a gram as a text of their own; a space between two keeps them apart and is no token
        w = Words(pa.array([b" ".join(gram)]).cast(pa.string(), safe=False), kind=op._KIND)
        return int((w.hash[0] if len(gram) == 1 else w.span_hash(np.array([0]), 2)[0]) >> np.uint64(50))

    every = [grams(t) for _, t, *_ in doc_rows]
    of = {g: bucket(g) for gs in every for g in set(gs)}
    good = {3, 10, 13, 22}
    raw, target = np.ones(op.BUCKETS), np.ones(op.BUCKETS)
    for (i, *_), gs in zip(doc_rows, every, strict=True):
        for g in gs:
            raw[of[g]] += 1
            target[of[g]] += i in good
    weight = np.log(target / target.sum()) - np.log(raw / raw.sum())
    ratios = [sum(weight[of[g]] for g in gs) / max(1, len(gs)) for gs in every]
    known = np.array([x for (i, *_), x in zip(doc_rows, ratios, strict=True) if i in good])
    threshold = np.median(known) - 6 * max(1.4826 * np.median(np.abs(known - np.median(known))), 1e-3)
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    got = op.quality_rules(docs, labels).collect()
    want = Counter((i, round(x, 9), bool(x >= threshold) and not brute(t)[-1]) for (i, t, *_), x in zip(doc_rows, ratios, strict=True))
    assert Counter((r["doc_id"], round(r["ratio"], 9), r["kept"]) for r in got) == want


def test_no_labels_and_empty(docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in op.quality_rules(docs, labels).collect())
    assert op.quality_rules(no_docs, labels).collect() == []


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in op10_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(r["kept"] for r in good) > 0.97 * len(good)
    assert sum(r["kept"] for r in bad) < 0.5 * len(bad)
