"""One text of over a megabyte among short ones: it is read whole, in a slice of its own."""

import random

import pytest

from catalith.llm import minhash_dedup, quality_rules, substring_dedup, toxicity
from catalith.llm.common import SLICE_BYTES
from tests.llm import test_minhash_dedup, test_quality_rules, test_substring_dedup, test_tokens


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = [f"w{r.randrange(10**6)}" for _ in range(180_000)]
    long = " ".join(words)
    assert len(long) > 4 * SLICE_BYTES and len(long) > 1 << 20
    tail, edited = words[-300:], list(words)
    edited[90_000] = "edited"
    return [(1, " ".join(words[100_000:100_200])), (2, long), (3, " ".join(["x", *tail])), (4, " ".join(edited)), (5, None), (6, "")]


@pytest.fixture(scope="module")
def long_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_substrings(long_docs, rows):
    assert sorted(map(tuple, substring_dedup.digest(substring_dedup.substring_dedup(long_docs)).collect())) == test_substring_dedup.brute(rows)


def test_near_duplicates(long_docs, rows):
    got = test_minhash_dedup.Counter(map(tuple, minhash_dedup.near_duplicates(long_docs).collect()))
    assert got == test_minhash_dedup.brute(rows)
    assert got[(4, 179_998, 2, False)] == 1


def test_toxicity(long_docs, spark):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r["doc_id"] for r in toxicity.score_toxicity(long_docs, labels).collect()) == [1, 2, 3, 4, 5, 6]


def test_quality(long_docs, rows, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (*(r[k] for k in quality_rules.COUNTS), r["base_failed"]) for r in quality_rules.quality_rules(long_docs, labels).collect()}
    assert got == {i: test_quality_rules.brute(t) for i, t in rows}


def test_packing_and_token_files(long_docs, rows):
    from catalith.llm import packing, token_files

    test_tokens.check_pieces(packing.pack(long_docs, test_tokens.WORD, spaced=False, end_id=1).collect(), rows)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_digest(long_docs, test_tokens.BYTE, spaced=True, end_id=0).collect()}
    start, want = 0, {}
    for (i, _), ids in zip(rows, test_tokens.ids_of(test_tokens.BYTE, [t for _, t in rows], 0), strict=True):
        want[i] = (start, len(ids), test_tokens.crc(ids))
        start += len(ids)
    assert got == want
