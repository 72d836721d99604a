"""Approximate nearest neighbours by collision counting on query-centred windows.

Every vector is projected on LINES random lines, and each line's projections are sorted. A query opens a window
around its own projection on every line, and virtual rehashing widens all windows by one factor at a time
(Gan et al. 2012; Huang et al. 2015). A vector in the windows of COLLISIONS of the lines is a candidate, and the
distance of each candidate is computed once. A query ends when it has k candidates and its windows are COVER times as
wide, to each side, as the k-th of their distances: a vector nearer than that lies in a window with a probability of
81 % for each line, so it is no candidate with one of 2 %, in any number of dimensions and at any size; or
when all vectors are candidates.

Vectors are dealt by a hash of their id into blocks, each with sorted lines of its own, and every query visits every
block, as no block can be left out without knowing what is in it; so the work grows as vectors times queries, divided by
what the windows leave out. A group of a block's vectors and up to QUERIES_IN_BLOCK queries is one task's,
of bounded size whatever the data; it gives each query's k best, so the last step ranks k rows for each query and block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 64
COLLISIONS = 0.7
#: First half-width of a window in units of the spread of the projections, its growth, and where it ends in units of the k-th distance.
FIRST, GROWTH, COVER = 0.35, 1.4, 1.3
VECTORS_IN_BLOCK, QUERIES_IN_BLOCK = 8192, 16384
#: Queries whose collisions are counted together.
BATCH = 64
SEED = 20_240


class SortedLines:
    """The index of one block: its vectors, their projections in order on every line, and each vector's place there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], LINES))
        projected = (self.vectors @ self.lines).T
        by_line = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, by_line, axis=1)
        self.place = np.empty(by_line.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, by_line, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)
        self.spread = float(projected.std()) or 1.0
        self.verified = 0

    def collisions(self, at: np.ndarray, half: np.ndarray) -> np.ndarray:
        """For each query (its projections at, half the width of its windows) and vector, on how many lines the vector is in the window."""
        count = np.zeros((len(at), len(self.ids)), np.uint8)
        for j, (line, place) in enumerate(zip(self.sorted, self.place, strict=True)):
            low = np.searchsorted(line, at[:, j] - half).astype(place.dtype)
            high = np.searchsorted(line, at[:, j] + half, side="right").astype(place.dtype)
            count += (place - low[:, None]) < (high - low)[:, None]  # unsigned: a place before low is far beyond
        return count

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and distances of the k nearest candidates that aren't its own, nearest first, ties to smaller ids."""
        at, need = queries @ self.lines, math.ceil(COLLISIONS * LINES)
        known = np.zeros((len(queries), len(self.ids)), bool)
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        active, half = np.arange(len(queries)), np.full(len(queries), FIRST * self.spread)
        while len(active):
            new = (self.collisions(at[active], half[active]) >= need) & ~known[active]
            known[active] |= new
            for i, fresh in zip(active, new, strict=True):
                found = np.flatnonzero(fresh)
                self.verified += len(found)
                found = found[self.ids[found] != own[i]]
                distance = np.sqrt(((self.vectors[found] - queries[i]) ** 2).sum(1))
                found, distance = np.concatenate([best[i][0], found]), np.concatenate([best[i][1], distance])
                nearest = np.lexsort((self.ids[found], distance))[:k]
                best[i] = found[nearest], distance[nearest]
            enough = np.array([COVER * best[i][1][-1] if len(best[i][0]) == k else np.inf for i in active])
            ended = known[active].all(1) | (half[active] >= enough)
            half[active] = np.minimum(half[active] * GROWTH, enough)  # no wider than it need be
            active = active[~ended]
        return [(self.ids[found], distance) for found, distance in best]


def _search_task(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def task(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            index = SortedLines(*_matrix(vectors))
            ids, asked = _matrix(queries)
            for i in range(0, len(ids), BATCH):
                for own, (found, distance) in zip(ids[i : i + BATCH], index.search(asked[i : i + BATCH], ids[i : i + BATCH], k), strict=True):
                    out.append((np.full(len(found), own), found, distance))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols), strict=True)))

    return task


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return t.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def usable(v: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k nearest found among vectors, its own id excluded.

    Both have vec_id and embedding. score: the Euclidean distance of the vectors as given, in double. Vectors that are null,
    zero or hold a null or non-finite component take no part, nor do rows with a null id; vectors of another
    dimension than the query's are no candidates. With fewer than k candidates, all are returned. Equal distances: the
    smaller vec_id is nearer. Repeated rows of an id: one of them, the smallest as an array. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    real = [
        t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .where("vec_id is not null")
        .where(usable(F.col("v")))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .withColumn("dim", F.size("v"))
        for t in (vectors, queries)
    ]
    blocks, query_blocks = (max(1, math.ceil(t.count() / size)) for t, size in zip(real, (VECTORS_IN_BLOCK, QUERIES_IN_BLOCK), strict=True))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = real[0].select("dim", block(blocks).alias("block"), every(query_blocks).alias("query_block"), "vec_id", "v")
    asked = real[1].select("dim", every(blocks).alias("block"), block(query_blocks).alias("query_block"), "vec_id", "v")
    keys = ["dim", "block", "query_block"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search_task(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
