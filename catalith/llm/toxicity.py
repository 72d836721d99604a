"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

A token's score is its log-odds between toxic and clean labelled documents, under a Dirichlet prior in
proportion to its share of both (Monroe, Colaresi, Quinn 2008), drawn towards 0 by its standard error; a token
without enough evidence of its own has the score of its longest beginning (HEADS, in bytes) with enough, and those
without that share the small negative score that is left for them. All maximal scoring segments of a
text are found in linear time (Ruzzo, Tompa 1999). A segment of score S in a text of n tokens has the normalized
score lambda * S - ln(K * n) (Karlin, Altschul 1990): lambda solves sum p * exp(lambda * s) = 1 over clean
tokens, K is set by the clean documents. A segment is significant at an expected number of chance hits of at
most MAX_EXPECTED. The r best significant segments of a text, whose normalized scores sum to T, occur by chance
with probability exp(-T) * T ** (r - 1) / (r! * (r - 1)!) (Karlin, Altschul 1993); the least probable choice of r
is the evidence of the text, or its best segment alone where fewer than two are significant. A logistic
curve over the evidence gives the probability of the label.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import Words, cut, free_name, freed, signed, slices

#: Labelled rows that the classifier is fitted on, chosen by a hash; bounds the broadcast and the vocabulary.
SAMPLE_ROWS = 20_000
#: A token or beginning needs so many documents with it, and so sure a difference in them, to have a score of its own.
MIN_DOCS = 5
MIN_Z = 4.0
HEADS = (4, 5, 6, 7, 8)
#: Occurrences in one document that count, so that one text that repeats a word is no evidence.
MAX_IN_DOC = 3
PRIOR_TOKENS = 500.0
MAX_EXPECTED = 0.01
THRESHOLD = 0.7

_KIND = np.zeros(256, np.uint8)
_KIND[128:] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # sorted hashes
    scores: np.ndarray
    rest: float  # the score of every other token
    decay: float  # lambda
    log_k: float
    slope: float
    bias: float

    def probability(self, normalized: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * normalized + self.bias, -30, 30)))

    def normalized(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.decay * best - self.log_k - np.log(np.maximum(n, 1))


def _features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and the hashes of what stands there: beginnings, the shortest first, then the words."""
    for size in HEADS:
        yield w.head_hash(size)
    yield np.arange(len(w.hash)), w.hash


def token_scores(w: Words, tokens: np.ndarray, scores: np.ndarray, rest: float) -> np.ndarray:
    out = np.full(len(w.hash), rest)
    if len(tokens):
        maybe = np.zeros(1 << 16, bool)
        maybe[tokens >> np.uint64(48)] = True
        for place, hashes in _features(w):
            some = maybe[hashes >> np.uint64(48)]
            place, hashes = place[some], hashes[some]
            at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
            same = tokens[at] == hashes
            out[place[same]] = scores[at[same]]
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    A segment stands on a stack with the prefix sums at its left end (low) and right end (high). A new
    positive token joins, with all between, the nearest segment on the left that starts lower, if that
    one does not already end as high.
    """
    stack: list[tuple[int, int, float, float]] = []
    below: list[int] = []  # for each segment, the nearest one to its left with a smaller low
    total = 0.0
    for i in np.flatnonzero(scores != 0):
        low, total = total, total + float(scores[i])
        if total <= low:
            continue
        start, end, high = int(i), int(i) + 1, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = below[j]
            if j < 0 or stack[j][3] >= high:
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:], below[j:]
        stack.append((start, end, low, high))
        below.append(j)
    return [(a, b, high - low) for a, b, low, high in stack]


def _best(scores: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The largest segment sum of each row (0 if none is positive)."""
    out = np.zeros(len(row) - 1)
    hot = np.unique(np.searchsorted(row, np.flatnonzero(scores > 0), side="right") - 1)
    for r in hot:
        total = np.concatenate([[0.0], np.cumsum(scores[row[r] : row[r + 1]])])
        out[r] = (total - np.minimum.accumulate(total)).max()
    return out


def significant(scores: np.ndarray, row: np.ndarray, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """The evidence of each row, and its significant segments (start, end, score), left to right."""
    n, best = np.diff(row), _best(scores, row)
    evidence = model.normalized(best, n)
    found: list[list[tuple[int, int, float]]] = [[] for _ in n]
    least = -math.log(MAX_EXPECTED)
    for i in np.flatnonzero(evidence >= least):  # no segment is better than the best
        all_ = [(a, b, x, float(model.normalized(np.float64(x), n[i]))) for a, b, x in maximal_segments(scores[row[i] : row[i + 1]])]
        found[i] = [(a, b, x) for a, b, x, s in all_ if s >= least]
        evidence[i] = max(evidence[i], sum_evidence([s for *_, s in all_ if s >= least]))
    return evidence, found


def sum_evidence(normalized: list[float]) -> float:
    """The largest -ln(probability) that the r best of the normalized scores reach their sum by chance, over r."""
    total, most = 0.0, -math.inf
    for r, s in enumerate(sorted(normalized, reverse=True), 1):
        total += s
        most = max(most, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return most


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each token or beginning: occurrences (MAX_IN_DOC in a document at most) and documents, clean and toxic."""
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"), lower=True, kind=_KIND)
            toxic = np.array(part.column("toxic").to_pylist(), np.int64)
            row = np.repeat(np.arange(len(part)), np.diff(w.row))
            found = list(_features(w))
            token, inverse = np.unique(np.concatenate([h for _, h in found]), return_inverse=True)
            cell, n = np.unique(inverse * len(part) + np.concatenate([row[p] for p, _ in found]), return_counts=True)
            token_of, bad = cell // len(part), toxic[cell % len(part)]
            sums = [np.bincount(token_of[bad == k], x[bad == k], len(token)).astype(np.int64) for x in (np.minimum(n, MAX_IN_DOC), np.ones(len(n))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), *map(pa.array, sums)], names=["token", "clean", "toxic", "clean_docs", "toxic_docs"])


def _bests(tokens: np.ndarray, scores: np.ndarray, rest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), lower=True, kind=_KIND)
                best = _best(token_scores(w, tokens, scores, rest), w.row)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(np.diff(w.row)), pa.array(best)], names=["toxic", "n", "best"])

    return task


def _evidence(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), lower=True, kind=_KIND)
                evidence, _ = significant(token_scores(w, model.tokens, model.scores, model.rest), w.row, model)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(evidence)], names=["toxic", "evidence"])

    return task


def _shares(tokens: np.ndarray, scores: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many tokens have each score; 0 stands for those without one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), lower=True, kind=_KIND)
                toxic = np.repeat(np.array(part.column("toxic").to_pylist(), np.int64), np.diff(w.row))
                found = token_scores(w, tokens, scores, 0.0)
                for k in (0, 1):
                    value, n = np.unique(found[toxic == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(value), pa.array(n)], names=["toxic", "score", "n"])

    return task


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method, with a small ridge."""
    middle, width = float(x.mean()), float(x.std()) or 1.0
    z, beta = np.stack([(x - middle) / width, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-3 * np.eye(2), z @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / width), float(beta[1] - beta[0] * middle / width)


def _decay(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(t * scores)) = 1; 1 if there is none."""
    value = lambda t: float(share @ np.exp(np.minimum(t * scores, 50))) - 1
    if share @ scores >= 0 or not (scores > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most SAMPLE_ROWS labelled rows, none of whose crc32(doc_id) mod 3 is 1.

    Labels that are null are no labels. Without toxic or without clean rows the model scores nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_of"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("_of is not null and toxic in (0, 1)").where("crc32(cast(_of as string)) % 3 <> 1").groupBy("_of").agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("_of"), "_of").limit(SAMPLE_ROWS))  # 12 bytes for each of SAMPLE_ROWS
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("_of")).select("text", "toxic")
    sample = cut(sample)  # the documents are read once to fit
    counted = sample.mapInArrow(_count, "token long, clean long, toxic long, clean_docs long, toxic_docs long")
    counted = counted.groupBy("token").agg(*(F.sum(k).alias(k) for k in ("clean", "toxic", "clean_docs", "toxic_docs")))
    size = sample.mapInArrow(_bests(np.zeros(0, np.uint64), np.zeros(0), 0.0), "toxic int, n long, best double").groupBy("toxic").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    sizes = {r["toxic"]: r for r in size.collect()}
    n_clean, n_toxic = (float(sizes[k]["n"]) if k in sizes else 0.0 for k in (0, 1))
    if not n_clean or not n_toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, 0.0, 0.0, -30.0)
    # Surely more or less often in toxic documents than in clean ones, by the difference of the shares of documents.
    share, width = "(toxic_docs + 0.5) / {1} - (clean_docs + 0.5) / {0}", "sqrt((toxic_docs + 0.5) / ({1} * {1}) + (clean_docs + 0.5) / ({0} * {0}))"
    sure = f"abs({share}) >= {MIN_Z} * {width}".format(*(float(sizes[k]["docs"]) for k in (0, 1)))
    own = counted.where(f"toxic_docs + clean_docs >= {MIN_DOCS}").where(sure).collect()
    token = np.array([r["token"] for r in own], np.int64).view(np.uint64)
    clean, toxic = (np.array([r[k] for r in own], float) for k in ("clean", "toxic"))
    prior = PRIOR_TOKENS * (clean + toxic) / (n_clean + n_toxic)
    odds = lambda x, n: np.log(x + prior) - np.log(n + PRIOR_TOKENS - x - prior)
    delta, error = odds(toxic, n_toxic) - odds(clean, n_clean), np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    sure = np.abs(delta) > error
    order = np.argsort(token[sure])
    token, scores = token[sure][order], (np.sign(delta) * (np.abs(delta) - error))[sure][order]
    # What is left for the others, and the share of each score among clean tokens, from the sample scored so far.
    marks = sample.mapInArrow(_shares(token, scores), "toxic int, score double, n long").groupBy("toxic", "score").agg(F.sum("n").alias("n")).toPandas()
    part = {k: float(marks.loc[(marks["toxic"] == k) & (marks["score"] == 0), "n"].sum()) for k in (0, 1)}
    rest = min(-1e-3, float(np.log(max(1.0, part[1]) / n_toxic) - np.log(max(1.0, part[0]) / n_clean)))
    among = marks[marks["toxic"] == 0]
    decay = _decay(among["n"].to_numpy(float) / n_clean, np.where(among["score"] == 0, rest, among["score"]))
    seen = sample.mapInArrow(_bests(token, scores, rest), "toxic int, n long, best double").toPandas()  # a row for each of SAMPLE_ROWS
    y, n, best = seen["toxic"].to_numpy(float), np.maximum(seen["n"].to_numpy(float), 1), seen["best"].to_numpy()
    log_k = float(np.median((decay * best - np.log(n))[y == 0])) + float(np.log(np.log(2)))
    model = Model(token, scores, rest, decay, log_k, 0.0, 0.0)
    seen = sample.mapInArrow(_evidence(model), "toxic int, evidence double").toPandas()
    slope, bias = _logistic(seen["evidence"].to_numpy(), seen["toxic"].to_numpy(float))
    return Model(token, scores, rest, decay, log_k, slope, bias)


def _score(model: Model, passages: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), lower=True, kind=_KIND)
                evidence, all_ = significant(token_scores(w, model.tokens, model.scores, model.rest), w.row, model)
                p = model.probability(evidence)
                found = [[{"start": a, "end": b, "score": x} for a, b, x in segments] for segments in all_]
                cols = [part.column("doc_id"), pa.array(p), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(found, kind)] * passages)], names=["doc_id", "score", "n_passages", *(["passages"] * passages)])

    return task


def score_toxicity(docs: DataFrame, labels: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of each document; passages: their words and scores too.

    score: the probability of the toxic label; predicted: 1 if it is THRESHOLD or more. Only the text is
    scored. Null or empty text: the score of a text without toxic tokens, no passages. Null doc_id: scored,
    not held out, never learned from. Repeated rows: each is scored. A doc_id labelled twice counts as
    toxic if either is. A text of any length is scanned whole; of segments that tie, all count. Other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    spans = ", passages array<struct<start: int, end: int, score: double>>" if passages else ""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(_score(model, passages)), f"doc_id long, score double, n_passages long{spans}")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", *(["passages"] * passages))


def mark_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with one more column, _toxic: whether score_toxicity predicts 1. All rows and columns pass, as in score_toxicity.

    Where docs has a column of this name, the new one has a further underscore before it; it is the last column.
    """
    model, names, mark = fit(docs, labels), docs.columns, free_name(docs, "_toxic")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for part in slices(batch):
                w = Words(part.column("text"), lower=True, kind=_KIND)
                evidence, _ = significant(token_scores(w, model.tokens, model.scores, model.rest), w.row, model)
                found.append(model.probability(evidence))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) >= THRESHOLD)], names=[*names, mark])

    return docs.mapInArrow(freed(task), docs.withColumn(mark, F.lit(True)).schema)
