"""Quality rules: plain counts of a text, and its hashed n-gram log-likelihood ratio.

Every text is cut into tokens (runs of letters and digits, or of other signs). Its words and word pairs fall
into hashed buckets. Two multinomials over the buckets are estimated, one from documents labelled
as good and one from all documents; a text's ratio is the mean over its n-grams of log p_target - log p_raw
(as in importance resampling: Xie et al. 2023). Instead of sampling by the ratio, every text is judged by one
fixed threshold taken from the ratios of the target texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import ASCII_SPACE, Words, cut, mix, slices

BUCKETS = 1 << 14
#: Bins that the ratios are narrowed by, and ratios that the driver gets at most, to find their median.
BINS, FEW = 1024, 20_000
#: The threshold lies so many (robust) standard deviations under the median ratio of the target texts.
DEVIATIONS = 6.0
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"

_KIND = np.full(256, 2, np.uint8)
_KIND[128:] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[ASCII_SPACE] = 0
_LINE = np.ones(256, np.uint8)
_LINE[10] = 0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _buckets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the row of each."""
    w = Words(text, kind=_KIND)
    row = np.repeat(np.arange(len(text)), np.diff(w.row))
    two = w.inside(2)
    keys = np.concatenate([w.hash, w.span_hash(two, 2)])
    return (keys >> np.uint64(50)).astype(np.int64), np.concatenate([row, row[two]])


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch):
            bucket, row = _buckets(part.column("text"))
            chosen = np.array(part.column("target").to_pylist(), bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[chosen[row]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def _ratios(text: pa.Array, weight: np.ndarray) -> np.ndarray:
    bucket, row = _buckets(text)
    n = np.bincount(row, minlength=len(text))
    return np.bincount(row, weight[bucket], minlength=len(text)) / np.maximum(n, 1)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it is a later one."""
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return n[back] > 1, later


def counts(text: pa.Array) -> dict[str, np.ndarray]:
    """The plain counts of each text; see quality_rules."""
    w = Words(text)
    size = len(text)
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[w.byte_row])
    out = {"n_words": np.diff(w.row).astype(np.int64)}
    out["word_chars"] = total(~ASCII_SPACE[w.data] & ((w.data & 0xC0) != 0x80))
    out["n_symbols"] = total(_SYMBOL[w.data])
    lines = Words(text, kind=_LINE)
    inked = np.concatenate([[0], np.cumsum(~ASCII_SPACE[w.data])])
    full = inked[lines.end] > inked[lines.start]
    row = np.repeat(np.arange(size), np.diff(lines.row)).astype(np.uint64)
    _, later = _repeats(mix(lines.hash[full] ^ mix(row[full] + np.uint64(1))))
    out["n_dup_lines"] = np.bincount(row[full][later].astype(np.int64), minlength=size)
    at = w.inside(8)
    row = np.repeat(np.arange(size), np.diff(w.row))
    twice, _ = _repeats(mix(w.span_hash(at, 8) ^ mix(row[at].astype(np.uint64) + np.uint64(1))))
    change = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + 8, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=size)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _at(values: DataFrame, rank: int, few: int) -> float:
    """The value number rank (from 0) of values(x), in order: bins are narrowed to the one that holds it until few values are left."""
    one = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    n, low, high = one
    while n > few and low < high:
        bins = F.floor((F.col("x") - low) / (high - low) * BINS)
        counts = values.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("bin").collect()  # BINS + 1 at most
        for r in counts:
            if rank < r["n"]:
                break
            rank -= r["n"]
        n, low, high = r["n"], r["low"], r["high"]
        values = values.where(F.col("x").between(low, high))
    return low if low == high else sorted(v["x"] for v in values.collect())[rank]


def median(values: DataFrame, few: int = FEW) -> float:
    """The exact median of values(x), whose driver gets few values at most."""
    n = values.count()
    low = _at(values, (n - 1) // 2, few)
    return low if n % 2 else (low + _at(values, n // 2, few)) / 2


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The weight of each bucket, and the threshold.

    Counts over all documents; the target is every row labelled quality = 1. Without target rows all weights are 0 and nothing falls below the threshold.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    good = F.broadcast(good)  # 8 bytes for each
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good, F.col("doc_id") == F.col("_good"), "left")
    counted = (
        joined.select("text", F.col("_good").isNotNull().alias("target"))
        .mapInArrow(_count_task, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    rows = sorted(counted.collect())  # one for each of BUCKETS
    raw, target = (np.array([r[i] for r in rows] or [0] * BUCKETS, float) for i in (1, 2))
    if not target.sum():
        return np.zeros(BUCKETS), -np.inf
    share = lambda x: (x + 1) / (x.sum() + BUCKETS)
    weight = np.log(share(target)) - np.log(share(raw))
    chosen = joined.where("_good is not null").select("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield pa.RecordBatch.from_arrays([pa.array(_ratios(part.column("text"), weight))], names=["x"])

    found = cut(chosen.mapInArrow(task, "x double"))  # a number for each target row
    middle = median(found)
    spread = max(1.4826 * median(found.select(F.abs(F.col("x") - middle).alias("x"))), 1e-3)
    return weight, float(middle - DEVIATIONS * spread)


def _judge(weight: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                c, ratio = counts(text), _ratios(text, weight)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                cols = [part.column("doc_id"), *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(~failed & (ratio >= threshold)), pa.array(ratio)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "base_failed", "kept", "ratio"])

    return task


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the ratio of each document.

    word_chars: code points in words; n_symbols: SYMBOLS anywhere; n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words in windows of 8 that occur twice or more in the text.
    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of them repeated. kept: not that, and a ratio
    at the threshold or over it. Null or empty text: all counts 0, ratio 0, base_failed. A null
    doc_id is judged like any other. Repeated rows: each is judged, and counts. A ratio that equals the threshold is
    kept. A text of any length is judged whole. Other columns, whatever their names, are not read. An empty table gives an
    empty result.
    """
    weight, threshold = fit(docs, labels)
    kinds = ", ".join(f"{k} long" for k in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _judge(weight, threshold), f"doc_id long, {kinds}, base_failed boolean, kept boolean, ratio double"
    )
