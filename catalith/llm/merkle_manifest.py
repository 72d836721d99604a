"""A Merkle tree over the rows of documents, with a proof for every row, by traversal in aligned blocks.

Leaves of a source stand in order; FAN consecutive nodes make one node above them, up to the source's root, and the roots of the
sources make the root of all in the same way. A block is FAN**LEVELS aligned nodes. In a block, the traversal walks leaf by
leaf and holds, for each height, the run of siblings at the present path; a treehash stack for each height takes one leaf a
step and has the next run ready just when the walk leaves the present one, so that at most a run and a stack of nodes stand
for each height. The nodes that blocks fold to are walked in blocks again until one is left; their paths, which all leaves of a
block share, are appended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import cut

#: The columns of a leaf in order, and the nodes that make one node above them.
FIELDS, FAN = ("doc_id", "source", "lang", "n_chars", "text"), 3
#: Heights of a block: at most FAN**LEVELS = 2,187 nodes.
LEVELS = 7

PATH = "path array<struct<before:string,after:string>>"


def levels(n: int) -> int:
    """How many heights n nodes need until one is left."""
    height = 0
    while FAN**height < n:
        height += 1
    return height


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Treehash:
    """A stack that folds leaves, given one by one, to nodes of a height; it holds at most FAN - 1 nodes of each height below, and one run of that height."""

    def __init__(self, height: int) -> None:
        self.height = height
        self.stack: list[tuple[int, str]] = []

    def update(self, leaf: str) -> None:
        self.stack.append((0, leaf))
        while (at := self.stack[-1][0]) < self.height and len(self.stack) >= FAN and self.stack[-FAN][0] == at:
            self.fold(FAN, at)

    def fold(self, n: int, at: int) -> None:
        run = [node for _, node in self.stack[-n:]]
        del self.stack[-n:]
        self.stack.append((at + 1, digest(run)))

    def finish(self) -> list[str]:
        """The run; where leaves ended early, shorter runs make a node as well."""
        for at in range(self.height):
            n = sum(1 for h, _ in self.stack if h == at)
            if n:
                self.fold(n, at)
        return [node for _, node in self.stack]


def walk(leaves: list[str], height: int) -> tuple[list[tuple[tuple[str, str], ...]], str]:
    """For each leaf of a block the siblings before and after it at each height, upwards; and the block's root."""
    if not height:
        return [()] * len(leaves), leaves[0]
    runs, ahead = [], [Treehash(h) for h in range(height)]
    for h in range(height):  # the path of the first leaf
        first = Treehash(h)
        for leaf in leaves[: FAN ** (h + 1)]:
            first.update(leaf)
        runs.append(first.finish())
    root, path, paths = digest(runs[-1]), [("", "")] * height, []
    for i in range(len(leaves)):
        for h in range(height):
            if i % FAN**h:
                break  # nothing changes from this height on
            if i and not i % FAN ** (h + 1):  # the walk enters the run that has been made meanwhile
                runs[h], ahead[h] = ahead[h].finish(), Treehash(h)
            own = i // FAN**h % FAN
            path[h] = ("".join(runs[h][:own]), "".join(runs[h][own + 1 :]))
        paths.append(tuple(path))
        for h in range(height):
            if i + FAN ** (h + 1) < len(leaves):
                ahead[h].update(leaves[i + FAN ** (h + 1)])
    return paths, root


def _block(columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    def task(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        paths, root = walk(nodes.column("node").to_pylist(), min(LEVELS, levels(nodes.column("n")[0].as_py())))
        flat = [x for p in paths for x in p]
        pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], ["before", "after"])
        ends = np.append(0, np.cumsum([len(p) for p in paths])).astype(np.int32)
        more = [pa.ListArray.from_arrays(pa.array(ends), pairs), pa.array([root] * len(paths), pa.string())]
        return pa.table([*(nodes.column(c) for c in columns), *more], names=[*columns, "path", "up"])

    return task


def climb(nodes: DataFrame) -> DataFrame:
    """nodes (tree, pos, n, node and others) with path and up: the siblings at each height of the block, and the node that the block folds to.

    pos counts the n nodes of a tree from 0. Written once.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    in_blocks = nodes.withColumn("_block", F.expr(f"pos div {FAN**LEVELS}"))
    return cut(in_blocks.groupBy("tree", "_block").applyInArrow(_block(nodes.columns), f"{schema}, {PATH}, up string"))


def above(nodes: DataFrame) -> DataFrame:
    """The nodes that blocks fold to, as nodes of the same trees."""
    size = FAN**LEVELS
    return nodes.where(f"pos % {size} = 0").select("tree", F.expr(f"pos div {size}").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("up").alias("node"))


def layers_of(nodes: DataFrame) -> list[DataFrame]:
    """climb() of nodes, of what their blocks fold to, and so on until every tree has one block; two layers at least, so that the last is small."""
    layers = [climb(nodes)]
    while True:
        layers.append(climb(above(layers[-1])))
        if (layers[-1].agg(F.max("n")).first()[0] or 0) <= FAN**LEVELS:
            return layers


def append_shared(layers: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The nodes of the first of layers with paths to the end of upper's (tree, pos, path and others), which is above the last of them."""
    for nodes in reversed(layers):
        shared = upper.withColumnsRenamed({"pos": "_block", "path": "_path"})
        met = nodes.drop("up").withColumn("_block", F.expr(f"pos div {FAN**LEVELS}")).join(shared, ["tree", "_block"])
        upper = met.withColumn("path", F.concat("path", "_path")).drop("_block", "_path")
        if nodes is not layers[0]:
            upper = upper.drop("n", "node")
    return upper


def leaf(text: Column | str = "text") -> Column:
    """The digest of the row's fields: each its length in bytes, a colon and the value, or - if it is null."""

    def said(c: Column | str) -> Column:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(said(text if c == "text" else c) for c in FIELDS)), 256)


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (source, doc_id, leaf and others) with tree (the place of their source), pos in it and its n; and how many sources there are.

    Rows are dealt by range, ties by where they stand, so a hot source is in many ranges; the driver gets each range's first and last source and
    their counts, and carries them from range to range.
    """
    spark = rows.sparkSession
    order = ["source", "doc_id", "leaf", "_tie"]
    dealt = cut(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per_source = dealt.groupBy("_range", "source").agg(F.count("*").alias("n")).withColumn("x", F.struct("source", "n"))
    ranges = per_source.groupBy("_range").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count("*").alias("n")).orderBy("_range").collect()
    before, trees, open_source, running = [], 0, None, 0
    for r in ranges:
        goes_on = trees > 0 and r["first"]["source"] == open_source
        trees -= goes_on
        before.append((trees, running if goes_on else 0))
        running = r["last"]["n"] + (before[-1][1] if r["n"] == 1 else 0)
        trees, open_source = trees + r["n"], r["last"]["source"]
    after, open_source, running = [], None, None
    for r in reversed(ranges):
        after.append(running if running is not None and r["last"]["source"] == open_source else 0)
        open_source, running = r["first"]["source"], r["first"]["n"] + (after[-1] if r["n"] == 1 else 0)
    known = [(r["_range"], *b, a, r["n"]) for r, b, a in zip(ranges, before, reversed(after), strict=True)]
    bounds = spark.createDataFrame(known, "_range int, _trees long, _before long, _after long, _sources long")
    of_range, of_source = Window.partitionBy("_range").orderBy("source"), Window.partitionBy("_range", "source")
    placed = dealt.select(
        "*",
        F.dense_rank().over(of_range).alias("_place"),
        F.row_number().over(of_source.orderBy("doc_id", "leaf", "_tie")).alias("_row"),
        F.count("*").over(of_source).alias("_rows"),
    ).join(F.broadcast(bounds), "_range")  # a row for each range
    is_first, is_last = F.col("_place") == 1, F.col("_place") == F.col("_sources")
    earlier = F.when(is_first, F.col("_before")).otherwise(0)
    out = placed.select(
        *rows.columns,
        (F.col("_trees") + F.col("_place") - 1).alias("tree"),
        (F.col("_row") - 1 + earlier).alias("pos"),
        (F.col("_rows") + earlier + F.when(is_last, F.col("_after")).otherwise(0)).alias("n"),
    )
    return out, trees


def merkle_manifest(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path (upwards, the siblings before and after the node) and found_leaf of each row.

    found_text: the text as a verifier finds it, for found_leaf; default: the text. Leaves of a source ascend by doc_id (null
    first), rows of one doc_id by their leaf; repeated rows are leaves each. Null is a source of its own, the first; values that are null
    or empty differ. Texts of any length are hashed whole. Columns beside FIELDS, whatever their names, are not read. An empty table has
    no rows and no root.
    """
    text = F.col("text") if found_text is None else found_text
    leaves = cut(docs.select("doc_id", "source", leaf().alias("leaf"), leaf(text).alias("found_leaf")))
    rows, n_sources = numbered(leaves)
    layers = layers_of(rows.withColumnRenamed("leaf", "node"))
    last = layers.pop().drop("n", "node").withColumnRenamed("up", "subroot")
    sources = layers_of(last.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_sources).cast("long").alias("n"), F.col("subroot").alias("node")))
    top = append_shared(sources, sources.pop().drop("n", "node").withColumnRenamed("up", "root"))
    top = top.select(F.col("pos").alias("tree"), F.col("path").alias("_path"), "root")
    upper = last.join(top, "tree").withColumn("path", F.concat("path", "_path")).drop("_path")
    return append_shared(layers, upper).select("doc_id", "source", F.col("node").alias("leaf"), "subroot", "root", "path", "found_leaf")


def folded(path: str, start: str) -> Column:
    """The root that the digest start folds to along a path."""
    return F.aggregate(path, F.col(start), lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


def digest_of_proofs(docs: DataFrame) -> DataFrame:
    """The contract's columns: rows whose doc_id has an even crc32 are verified with a text that lost its line feeds."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle_manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256).alias("proof_sha256"),
        folded("path", "found_leaf").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
