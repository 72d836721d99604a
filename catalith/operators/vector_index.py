"""An inverted-file index of vectors under cosine similarity, for approximate and for exact neighbours.

Vectors are made unit, so a similarity s is a distance of sqrt(2 - 2 s). Centres come from Spark's k-means over a bounded
sample; every vector belongs to the list of its nearest centre. Lists are stored in order of the distance to the centre and cut into
blocks of BLOCK_ROWS, so that a list that holds a third of all rows is many blocks, and each block is a ring around its
centre. A target meets blocks by equi-joins only:

- approximate: the blocks of its nearest lists. Rows are scored there by the centre and an 8-bit code of the residual, and
  the best ones are scored again by their vectors.
- exact: the blocks whose ring the triangle inequality can't rule out, |d(target, centre) - d(row, centre)| <= d(target, row). Blocks are
  shuffled in a few bundles, to each of which a target goes once at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.operators.vectors import BLOCK_ROWS, FOUND, TARGETS_AT_ONCE, THRESHOLD, TOP_K, _best, _matrix, _ranked, checked, grid_blocks, usable
from catalith.sources.stores import read_snapshot, replace_snapshot

#: Rows that centres are fitted on at most; centres at most (they go to every task); rounds of k-means.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 100_000, 4096, 8
#: Candidates by code for each neighbour wanted, of which the vectors decide.
REFINE = 8
#: What sums of squares in double precision may be off by.
SLACK = 1e-9

ROWS = "part int, at long, list int, far double, doc_id string, doc_type string, v array<double>, scale float, code binary"


@dataclass(frozen=True)
class VectorIndex:
    """rows: ROWS and block, in order of list and far; blocks: block, list, near and far of its ring, n; centres: one in each row."""

    rows: DataFrame
    blocks: DataFrame
    centres: np.ndarray


def default_lists(n: int) -> int:
    """Lists for n vectors: about the root of n, so that probing a list costs what finding it does."""
    return max(1, min(MAX_LISTS, round(math.sqrt(n))))


def exact_lists(n: int) -> int:
    """Lists for exact neighbours: of BLOCK_ROWS vectors, as a target's vector goes to every block that stays open; a few where n is small."""
    return max(1, min(MAX_LISTS, max(8, math.ceil(n / BLOCK_ROWS))))


def fit_centres(unit: DataFrame, lists: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The centres of k-means over sample_rows rows, those of the smallest hashes of their ids, so that the sample depends on the ids alone."""
    sample = unit.select("doc_id", array_to_vector("v").alias("v")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).coalesce(1).persist()
    try:
        found = KMeans(k=lists, maxIter=ROUNDS, seed=7, featuresCol="v", initMode="k-means||").fit(sample) if lists > 1 else None
        if found is None:
            return np.zeros((1, len(sample.first()["v"])))
        return np.array(found.clusterCenters())  # MAX_LISTS rows at most
    finally:
        sample.unpersist()


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] - 2 * (v @ centres.T) + (centres * centres).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _assigner(centres: np.ndarray):  # noqa: ANN202
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(i, BLOCK_ROWS)
                v = _matrix(part.column("v"))
                d = _distances(v, centres)
                own = d.argmin(1)
                rest = v - centres[own]
                scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
                codes = np.round(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(v), np.int32)),
                        pa.array(np.zeros(len(v), np.int64)),
                        pa.array(own.astype(np.int32)),
                        pa.array(np.linalg.norm(rest, axis=1)),
                        *(part.column(k) for k in ("doc_id", "doc_type", "v")),
                        pa.array(scale.astype(np.float32)),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                    ],
                    names=[x.split()[0] for x in ROWS.split(", ")],
                )

    return task


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order get the number of their part, and where they stand among the part's rows of their list."""
    part, seen, last = TaskContext.get().partitionId(), 0, None
    for b in batches:
        lists = b.column("list").to_numpy()
        start = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        at = np.arange(len(lists)) - np.repeat(start, np.diff(np.append(start, len(lists))))
        if len(lists) and lists[0] == last:
            at[lists == last] += seen
        if len(lists):
            last, seen = lists[-1], at[-1] + 1
        yield b.set_column(0, "part", pa.array(np.full(len(lists), part, np.int32))).set_column(1, "at", pa.array(at))


def write_vector_index(vectors: DataFrame, folder: str, lists: int | None = None, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """Indexes every usable row of vectors (doc_id, doc_type, vector) under folder. lists: default by the number of rows.

    Null, zero and non-finite vectors take no part; of repeated ids one row does. Without any row the index is empty.
    """
    spark, unit = vectors.sparkSession, usable(vectors)
    n = unit.count()
    centres = fit_centres(unit, min(lists or default_lists(n), MAX_LISTS, n)) if n else np.zeros((0, 0))
    order = ["list", "far", "doc_id"]
    assigned = unit.select("doc_id", "doc_type", "v").mapInArrow(_assigner(centres), ROWS)
    dealt = assigned.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, ROWS)
    replace_snapshot(dealt, f"{folder}/rows", also_empty=True)
    # Blocks don't depend on how rows were dealt: a list goes on from part to part. A row for each part and list that meet, parts and lists at most.
    counts = read_snapshot(spark, f"{folder}/rows").groupBy("list", "part").agg(F.count("*").alias("n")).orderBy("list", "part").collect()
    parts, before = [], 0
    for i, r in enumerate(counts):
        before = before + counts[i - 1]["n"] if i and counts[i - 1]["list"] == r["list"] else 0
        parts.append((r["list"], r["part"], before, block_rows))
    replace_snapshot(spark.createDataFrame(parts, "list int, part int, before long, block_rows int"), f"{folder}/parts", also_empty=True)
    rings = _rows(spark, folder).groupBy("block", "list").agg(F.min("far").alias("near"), F.max("far").alias("far"), F.count("*").alias("n"))
    replace_snapshot(rings, f"{folder}/blocks", also_empty=True)
    replace_snapshot(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>"), f"{folder}/centres", also_empty=True)
    return read_vector_index(spark, folder)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows with the block that they are in."""
    parts = F.broadcast(read_snapshot(spark, f"{folder}/parts"))  # as many rows as parts and lists
    number = F.expr("shiftleft(cast(list as long), 32) + (before + at) div block_rows")
    return read_snapshot(spark, f"{folder}/rows").join(parts, ["list", "part"]).withColumn("block", number).drop("before", "block_rows")


def read_vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    centres = read_snapshot(spark, f"{folder}/centres").orderBy("list").collect()  # MAX_LISTS rows at most
    return VectorIndex(_rows(spark, folder), read_snapshot(spark, f"{folder}/blocks"), np.array([r["centre"] for r in centres]))


def _probes(targets: DataFrame, centres: np.ndarray, pick) -> DataFrame:  # noqa: ANN001
    """target, tv, list, d of each target and each list that pick chooses from its distances to all centres."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                d = _distances(_matrix(part.column("v")), centres)
                row, found = pick(d)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("v").take(pa.array(row)), pa.array(found.astype(np.int32)), pa.array(d[row, found])], names=["target", "tv", "list", "d"])

    return targets.select("doc_id", "v").mapInArrow(task, "target string, tv array<double>, list int, d double")


def _meet(index: VectorIndex, asked: DataFrame, columns: list[str], score, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:  # noqa: ANN001
    """score(rows of a block, targets) over all blocks and the targets asked (block, target, tv and others) there, block_rows targets at a time."""
    chunks = asked.groupBy("block").agg(F.count("*").alias("_n")).select("block", F.expr(f"cast((_n + {block_rows - 1}) div {block_rows} as int)").alias("_chunks"))
    chunk = F.pmod(F.xxhash64("target"), F.col("_chunks").cast("long")).cast("int")
    dealt = asked.join(chunks, "block").withColumn("chunk", chunk).drop("_chunks")
    rows = index.rows.select("block", *columns).join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    return dealt.groupBy("block", "chunk").cogroup(rows.groupBy("block", "chunk")).applyInArrow(score, schema)


def search(index: VectorIndex, targets: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD, probes: int = 10) -> DataFrame:
    """Approximate neighbours of targets (doc_id, v, unit; see usable()), columns as in neighbours_of: those in the probes nearest lists of each.

    A target may be a row of the index; it is not its own neighbour.
    """
    checked(top_k, threshold)
    centres, wanted = index.centres, (top_k + 1) * REFINE
    if not len(centres):
        return _ranked(targets.sparkSession.createDataFrame([], FOUND), index.rows, top_k, threshold)
    few = min(probes, len(centres))

    def pick(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.argpartition(d, few - 1, axis=1)[:, :few]
        return np.repeat(np.arange(len(d)), few), found.ravel()

    asked = _probes(targets, centres, pick).join(index.blocks.select("block", "list"), "list")

    def by_code(asked: pa.Table, rows: pa.Table) -> pa.Table:
        a, i, s = [], [], []
        if asked.num_rows and rows.num_rows:
            t = _matrix(asked.column("tv"))
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(rows.num_rows, -1).astype(np.float32)
            about = t @ centres[asked.column("list")[0].as_py()]  # a block is of one list
            scale, few = rows.column("scale").to_numpy(), min(wanted, rows.num_rows)
            for at in range(0, len(t), TARGETS_AT_ONCE):  # so that memory does not grow with the targets of a block
                part = slice(at, at + TARGETS_AT_ONCE)
                scores = about[part, None] + (t[part].astype(np.float32) @ codes.T) * scale
                best = np.argpartition(-scores, few - 1, axis=1)[:, :few]
                a.append(np.repeat(np.arange(at, at + len(best)), few))
                i.append(best.ravel())
                s.append(np.take_along_axis(scores, best, 1).ravel())
        if not a:
            return pa.table({"block": pa.array([], pa.int64()), "target_doc_id": pa.array([], pa.string()), "doc_id": pa.array([], pa.string()), "about": pa.array([], pa.float64())})
        own, row, score = (pa.array(np.concatenate(x)) for x in (a, i, s))
        block = pa.array(np.full(len(own), asked.column("block")[0].as_py(), np.int64))
        return pa.table({"block": block, "target_doc_id": asked.column("target").take(own), "doc_id": rows.column("doc_id").take(row), "about": score.cast(pa.float64())})

    coded = _meet(index, asked.select("block", "list", "target", "tv"), ["doc_id", "scale", "code"], by_code, "block long, target_doc_id string, doc_id string, about double")
    order = Window.partitionBy("target_doc_id").orderBy(F.col("about").desc(), "doc_id")
    chosen = coded.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= wanted).select("block", "target_doc_id", "doc_id")
    dot = F.aggregate(F.zip_with("tv", "v", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    vectors = chosen.join(index.rows.select("block", "doc_id", "v"), ["block", "doc_id"]).join(targets.select(F.col("doc_id").alias("target_doc_id"), F.col("v").alias("tv")), "target_doc_id")
    return _ranked(vectors.select("target_doc_id", "doc_id", dot.alias("similarity_score")), index.rows, top_k, threshold)


def _open_blocks(index: VectorIndex, targets: DataFrame, threshold: float) -> DataFrame:
    """target, tv, block of all blocks that may hold a row at the threshold or nearer."""
    rings = index.blocks.groupBy("list").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect()  # MAX_LISTS rows at most
    near, far = np.full(len(index.centres), np.inf), np.full(len(index.centres), -np.inf)
    for r in rings:
        near[r["list"]], far[r["list"]] = r["near"], r["far"]
    most = _farthest(threshold)

    def pick(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((d - far <= most) & (near - d <= most))

    asked = _probes(targets, index.centres, pick).join(index.blocks.select("block", "list", "near", "far"), "list")
    return asked.where((F.col("d") - F.col("far") <= most) & (F.col("near") - F.col("d") <= most)).select("block", "target", "tv")


def exact_neighbours(index: VectorIndex, targets: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """The same rows as all_neighbours() for targets (doc_id, v, unit), from the blocks that the triangle inequality leaves open."""
    checked(top_k, threshold)
    if not len(index.centres):
        return _ranked(targets.sparkSession.createDataFrame([], FOUND), index.rows, top_k, threshold)

    bundles, bundle_of = _bundles(index)
    chunks = grid_blocks(targets.count())
    asked = _asked_bundles(index, targets, bundles, threshold).withColumn("chunk", F.pmod(F.xxhash64("target"), F.lit(chunks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    rows = index.rows.join(F.broadcast(bundle_of), "block").select("bundle", every.alias("chunk"), "block", "list", "far", "doc_id", "v")  # a row for each block
    centres, most = index.centres, _farthest(threshold)

    def by_vector(asked: pa.Table, rows: pa.Table) -> pa.Table:
        a, i, s = [], [], []
        if asked.num_rows and rows.num_rows:
            ids, names, v, t = rows.column("doc_id").to_pylist(), asked.column("target").to_pylist(), _matrix(rows.column("v")), _matrix(asked.column("tv"))
            block, own, far = (rows.column(c).to_numpy() for c in ("block", "list", "far"))
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                d = _distances(t, centres[own[at[0]]][None])[:, 0]
                met = np.flatnonzero((d - far[at].max() <= most) & (far[at].min() - d <= most))
                if len(met):
                    found = _best([ids[j] for j in at], v[at], [names[j] for j in met], t[met], top_k, threshold)
                    for whole, more in zip((a, i, s), found, strict=True):
                        whole.extend(more)
        return pa.table({"target_doc_id": pa.array(a, pa.string()), "doc_id": pa.array(i, pa.string()), "similarity_score": pa.array(s, pa.float64())})

    found = asked.groupBy("bundle", "chunk").cogroup(rows.groupBy("bundle", "chunk")).applyInArrow(by_vector, FOUND)
    return _ranked(found, index.rows, top_k, threshold)


def _farthest(threshold: float) -> float:
    """The distance of a similarity."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def _bundles(index: VectorIndex) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], DataFrame]:
    """For each bundle the list, near and far of its blocks; and the bundle of each block: grid_blocks() of them, with about as many rows each."""
    known = index.blocks.select("block", "list", "near", "far", "n").orderBy(F.col("n").desc(), "block").collect()  # a row for BLOCK_ROWS vectors or a list
    count = grid_blocks(sum(r["n"] for r in known))
    held, parts, rows = [0] * count, [[] for _ in range(count)], []
    for r in known:
        least = held.index(min(held))
        held[least] += r["n"]
        parts[least].append(r)
        rows.append((r["block"], least))
    rings = [tuple(np.array([r[k] for r in p]) for k in ("list", "near", "far")) for p in parts if p]
    return rings, index.rows.sparkSession.createDataFrame(rows, "block long, bundle int")


def _asked_bundles(index: VectorIndex, targets: DataFrame, bundles: list, threshold: float) -> DataFrame:
    """target, tv, bundle of all bundles that hold a block that may have a row at the threshold or nearer."""
    centres, most = index.centres, _farthest(threshold)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                d = _distances(_matrix(part.column("v")), centres)
                for k, (own, near, far) in enumerate(bundles):
                    met = pa.array(np.flatnonzero(((d[:, own] - far <= most) & (near - d[:, own] <= most)).any(1)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(met), part.column("v").take(met), pa.array(np.full(len(met), k, np.int32))], names=["target", "tv", "bundle"])

    return targets.select("doc_id", "v").mapInArrow(task, "target string, tv array<double>, bundle int")


def compared(index: VectorIndex, targets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pairs that exact_neighbours() compares, and all_pairs of the targets with the index's rows."""
    opened = _open_blocks(index, targets, threshold).join(index.blocks.select("block", "n"), "block").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    every = index.rows.agg(F.count("*").alias("rows")).crossJoin(targets.agg(F.count("*").alias("asked")))  # one row each
    return opened.crossJoin(every.select((F.col("rows") * F.col("asked")).alias("all_pairs")))
