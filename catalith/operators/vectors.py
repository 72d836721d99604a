"""Vectors of listings: their text, an encoder of the caller's choice, and cosine neighbours.

Neighbours are exact. Targets that a request names are few and meet every batch of the corpus once. All targets at
once meet the corpus in a grid of GRID blocks of either side, so that a row is shuffled GRID times, however many rows there are, until
blocks reach their largest size; a pair of blocks gives each target's best rows only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
#: Rows of a block; texts that an encoder gets at once.
BLOCK_ROWS, ENCODER_BATCH = 4096, 32
#: Blocks of the rows that meet each other: as many while they hold LARGEST * BLOCK_ROWS rows at most, fewer where BLOCK_ROWS fill them; targets scored at once in a task.
GRID, LARGEST, TARGETS_AT_ONCE = 8, 16, 64
#: The least similarity, neighbours kept, and targets of one request.
THRESHOLD, TOP_K, MAX_TARGETS = 0.5, 4, 100
#: Fixed value: the most neighbours that a request may ask for.
MAX_TOP_K = 20
FOUND = "target_doc_id string, doc_id string, similarity_score double"


def embedding_text(with_office: bool = True) -> Column:
    """Title, description, keywords and, in the long form, office and category in one text; missing parts are empty."""
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    keywords = F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")
    parts = [text("list_title"), F.lit(". "), text("desc"), F.lit(". 핵심키워드: "), keywords]
    if with_office:
        parts += [F.lit(". 기관: "), text("org_nm"), F.lit(". 카테고리: "), text("category_nm")]
    return F.concat(*parts)


def hash_encoder(size: int = 64) -> Encoder:
    """An encoder without a model: signed hashed words. The same text always has the same vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % size] += 1 if h >> 63 else -1
        return out

    return encode


def encode(docs: DataFrame, encoder: Encoder, text: Column, batch: int = ENCODER_BATCH) -> DataFrame:
    """doc_id, doc_type, content, vector of docs (doc_id, doc_type and what text reads)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = [x.astype(np.float32) for x in encoder([x or "" for x in part.column("content").to_pylist()])]
                yield part.append_column("vector", pa.array(vectors, pa.list_(pa.float32())))

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_type").cast("string").alias("doc_type"), text.alias("content"))
    return rows.mapInArrow(task, "doc_id string, doc_type string, content string, vector array<float>")


def usable(vectors: DataFrame) -> DataFrame:
    """Unit vectors (doc_id, doc_type, v) of rows whose vector isn't null or zero; the smallest of the rows of one id."""
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.where("doc_id is not null and vector is not null").withColumn("_norm", norm).where("_norm > 0 and not isnan(_norm)")
    unit = rows.select("doc_id", F.coalesce("doc_type", F.lit("API")).alias("doc_type"), F.transform(v, lambda x: x / F.col("_norm")).alias("v"))
    return unit.groupBy("doc_id").agg(F.min(F.struct("doc_type", "v")).alias("x")).select("doc_id", "x.doc_type", "x.v")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(ids: list[str], v: np.ndarray, targets: list[str], t: np.ndarray, k: int, least: float) -> tuple[list[str], list[str], list[float]]:
    """For each target its k best rows, those equal to the last one included."""
    found: tuple[list[str], list[str], list[float]] = ([], [], [])
    for a in range(0, len(targets), TARGETS_AT_ONCE):
        for name, score in zip(targets[a : a + TARGETS_AT_ONCE], t[a : a + TARGETS_AT_ONCE] @ v.T, strict=True):
            good = np.flatnonzero(score >= least - 1e-9)
            if len(good) > k + 1:
                good = good[score[good] >= np.partition(score[good], len(good) - k - 1)[len(good) - k - 1] - 1e-12]
            found[0].extend([name] * len(good))
            found[1].extend(ids[i] for i in good)
            found[2].extend(score[good].tolist())
    return found


def grid_blocks(n: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks for n rows that each meet all blocks of the other side."""
    return max(1, min(GRID, math.ceil(n / block_rows)), math.ceil(n / (LARGEST * block_rows)))


def _ranked(found: DataFrame, types: DataFrame, top_k: int, threshold: float) -> DataFrame:
    order = Window.partitionBy("target_doc_id").orderBy(F.col("similarity_score").desc(), F.length("doc_id"), F.col("doc_id"))
    kept = found.where((F.col("similarity_score") >= threshold) & (F.col("doc_id") != F.col("target_doc_id")))
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.join(types.select("doc_id", "doc_type"), "doc_id").select("target_doc_id", "doc_id", "doc_type", "similarity_score", "rank")


def checked(top_k: int, threshold: float, targets: int = 1) -> None:
    """ValueError for what a request may not ask for."""
    if not 1 <= top_k <= MAX_TOP_K or not 0 <= threshold <= 1:
        raise ValueError(f"top_k is from 1 to {MAX_TOP_K} and threshold from 0 to 1")
    if targets > MAX_TARGETS:
        raise ValueError(f"at most {MAX_TARGETS} targets")


def neighbours_of(vectors: DataFrame, targets: list[str], top_k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """The neighbours of up to MAX_TARGETS ids: target_doc_id, doc_id, doc_type, similarity_score, rank. An unknown id has none."""
    checked(top_k, threshold, len(targets))
    unit = usable(vectors)
    known = unit.where(F.col("doc_id").isin(list(targets))).select("doc_id", "v").collect()  # MAX_TARGETS rows at most
    names, matrix = [r["doc_id"] for r in known], np.array([r["v"] for r in known], float)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and names:
                a, i, s = _best(b.column("doc_id").to_pylist(), _matrix(b.column("v")), names, matrix, top_k, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(i, pa.string()), pa.array(s, pa.float64())], names=["target_doc_id", "doc_id", "similarity_score"])

    return _ranked(unit.select("doc_id", "v").mapInArrow(task, FOUND), unit, top_k, threshold)


def all_neighbours(vectors: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, targets: DataFrame | None = None) -> DataFrame:
    """The neighbours of every row of vectors, or of those in targets(doc_id); columns as in neighbours_of."""
    checked(top_k, threshold)
    unit = usable(vectors)
    chosen = unit if targets is None else unit.join(targets.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = unit.agg(F.count("*").alias("n")).withColumn("k", F.lit(0)).unionByName(chosen.agg(F.count("*").alias("n")).withColumn("k", F.lit(1)))
    blocks, target_blocks = (grid_blocks(r["n"], block_rows) for r in sorted(sizes.collect(), key=lambda r: r["k"]))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    corpus, asked = unit.select(own(blocks).alias("b"), every(target_blocks).alias("t"), "doc_id", "v"), chosen.select(every(blocks).alias("b"), own(target_blocks).alias("t"), F.col("doc_id").alias("target"), F.col("v").alias("tv"))

    def task(c: pa.Table, t: pa.Table) -> pa.Table:
        a, i, s = [], [], []
        if c.num_rows and t.num_rows:
            a, i, s = _best(c.column("doc_id").to_pylist(), _matrix(c.column("v")), t.column("target").to_pylist(), _matrix(t.column("tv")), top_k, threshold)
        return pa.table({"target_doc_id": pa.array(a, pa.string()), "doc_id": pa.array(i, pa.string()), "similarity_score": pa.array(s, pa.float64())})

    found = corpus.groupBy("b", "t").cogroup(asked.groupBy("b", "t")).applyInArrow(task, FOUND)
    return _ranked(found, unit, top_k, threshold)


def replace_vectors(vectors: DataFrame, changed: DataFrame) -> DataFrame:
    """vectors with the rows of changed in place of those with their ids."""
    return without_vectors(vectors, changed).unionByName(changed)


def without_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
