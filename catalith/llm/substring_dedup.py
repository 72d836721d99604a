"""Removal of long passages that a document shares with an earlier one, by De Bruijn compaction.

The edges of the graph are the word k-mers of all documents (k = 50 words by default). They are never
shuffled one by one: as in minimizer-based compaction (Chikhi, Limasset, Medvedev 2016), consecutive
k-mers of a document that share the smallest hash of the shorter k-mers inside them form a *run*, and two
equal k-mers always lie in runs with the same minimizer. A run is one row.

1.  Runs are aggregated by minimizer. Minimizers of a single document hold no repeated edge and go.
2.  Runs of one minimizer with the same content are one nonbranching path: they compact, by a Spark
    join, into their first document, and every copy in a later one is repeated as a whole.
3.  Where a minimizer has several paths (the graph branches there: the ends of a shared passage, an
    edited word), the copies of each path in its first document are opened into their k-mers again,
    read at their source coordinates, and compared edge by edge.
4.  The spans found are merged for each document and cut out of its text.

A k-mer is compared by two independent 64-bit values (minimizer and content), so a false match is out of
reach. Aggregations combine before the shuffle and joins have one row for each key on one side, so
a group of copies of any size is split among tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import Words, cut, free_name, freed, join_groups, signed, slices

RUNS = "doc_id long, start int, n int, m long, path long"
EDGES = "doc_id long, pos int, m long, edge long"
#: Words of a minimizer for windows of 50 words.
MINIMIZER_WORDS = 16


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    short = min(MINIMIZER_WORDS, window)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                at = w.inside(window)
                if not len(at):
                    continue
                least = _least(w.grams(short), window - short + 1)[at]
                first = np.ones(len(at), bool)
                first[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
                head = np.flatnonzero(first)
                n = np.diff(head, append=len(at))
                start = at[head]
                row = np.searchsorted(w.row, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array((start - w.row[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(signed(least[head])),
                        pa.array(signed(w.span_hash(start, n + window - 1))),
                    ],
                    names=["doc_id", "start", "n", "m", "path"],
                )

    return task


def edges_of(window: int, marks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k-mers of the runs asked for, read at their places in the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                ids, asked = part.column("doc_id").to_pylist(), part.column(marks)
                ends = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())])
                runs = asked.flatten()
                start, n, m = (runs.field(k).to_numpy() for k in ("start", "n", "m"))
                row = np.repeat(np.arange(len(ids)), np.diff(ends))
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(start, n) + offset
                word = pos + np.repeat(w.row[row], n)
                fits = word + window <= np.repeat(w.row[row + 1], n)  # all, unless rows with one doc_id differ
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(np.repeat(row, n)[fits])),
                        pa.array(pos[fits].astype(np.int32)),
                        pa.array(np.repeat(m, n)[fits]),
                        pa.array(signed(w.span_hash(word[fits], window))),
                    ],
                    names=["doc_id", "pos", "m", "edge"],
                )

    return task


def with_ids(docs: DataFrame) -> DataFrame:
    """The rows with a doc_id, which is long; no new column where it is already, so that plans stay equal."""
    return (docs if dict(docs.dtypes)["doc_id"] == "bigint" else docs.withColumn("doc_id", F.col("doc_id").cast("long"))).where("doc_id is not null")


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, spans): for each document with words to remove, the runs (start, n) of repeated windows.

    Window i of a run covers the words start + i to start + i + window - 1.
    """
    docs = with_ids(docs)
    runs = docs.select("doc_id", "text").mapInArrow(freed(runs_of(window)), RUNS)
    shared = (
        runs.groupBy("m")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("path") != F.max("path")).alias("branches"))
        .where("lo < hi")
        .drop("hi")
    )
    found = cut(join_groups(runs, shared, ["m"]))
    branching = found.where("branches").drop("lo", "branches")
    paths = branching.groupBy("m", "path").agg(F.min("doc_id").alias("first"))
    copies = join_groups(branching, paths, ["m", "path"])
    whole = found.where("not branches and doc_id > lo").select("doc_id", "start", "n").unionByName(
        copies.where("doc_id > first").select("doc_id", "start", "n")
    )
    of, marks = free_name(docs, "_of"), free_name(docs, "_runs")
    asked = (  # a set, as rows with one doc_id ask for the same
        copies.where("doc_id = first").groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("start", "n", "m")).alias(marks))
    )
    # All columns of docs pass here, so that this shuffle of the texts is the one that the caller's join reuses.
    edges = docs.join(asked, docs["doc_id"] == asked[of]).drop(of).mapInArrow(freed(edges_of(window, marks)), EDGES)
    first = edges.groupBy("m", "edge").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    single = join_groups(edges, first, ["m", "edge"]).where("doc_id > lo").select("doc_id", F.col("pos").alias("start"), F.lit(1).alias("n"))
    return whole.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _covered(n_words: int, window: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, np.minimum(start, n_words), 1)
    np.add.at(change, np.minimum(start + n + window - 1, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _cutter(names: list[str], added: list[str], marks: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was_null = batch.column("text").is_null().to_pylist()
            done = 0
            for part in slices(batch):
                w = Words(part.column("text"))
                spans = part.column(marks)
                texts: list[str | None] = []
                removed = np.zeros(len(part), np.int64)
                for i, given in enumerate(spans.is_valid().to_pylist()):
                    a, b = int(w.byte_row[i]), int(w.byte_row[i + 1])
                    raw = w.data[a:b].tobytes()
                    if given:
                        r0, r1 = w.row[i], w.row[i + 1]
                        s = spans[i].values
                        gone = _covered(int(r1 - r0), window, s.field("start").to_numpy(), s.field("n").to_numpy())
                        removed[i] = gone.sum()
                        start = w.start[r0:r1] - a
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                        keep, at = [], 0
                        for x, y in zip(turn[::2], turn[1::2], strict=True):
                            keep.append(raw[at : start[x]])
                            at = start[y] if y < len(start) else len(raw)
                        raw = b"".join([*keep, raw[at:]])
                    texts.append(None if was_null[done + i] else raw.decode())
                cols = [pa.array(texts, pa.string()) if k == "text" else part.column(k) for k in names]
                cols += [pa.array(np.diff(w.row).astype(np.int64)), pa.array(removed)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])
                done += len(part)

    return task


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with every word cut that lies in a window of `window` words found in a document of smaller doc_id.

    Adds _n_words and _n_removed (of the input). Kept words stay with the white space after them; a text
    that loses nothing is unchanged. Null text: stays null, no words. Text shorter than a window: unchanged.
    Null doc_id: the row is kept as it is and is no source. Rows that share a doc_id count as one document:
    none is a source for the other, and what is found in one is cut from each. A text of any length is read whole. Other
    columns pass through, whatever their names; the two new ones have further underscores where docs has their names. An
    empty table gives an empty result.
    """
    of, marks, *added = (free_name(docs, x) for x in ("_of", "_spans", "_n_words", "_n_removed"))
    spans = repeated_spans(docs, window).select(F.col("doc_id").alias(of), F.col("spans").alias(marks))
    real = with_ids(docs)
    out = real.join(spans, real["doc_id"] == spans[of], "left").drop(of)
    without = docs.where("doc_id is null").withColumn(marks, F.lit(None).cast(spans.schema[marks].dataType))
    out = out.unionByName(without)
    zero = F.lit(0).cast("long")
    schema = out.drop(marks).select("*", *(zero.alias(x) for x in added)).schema
    return out.mapInArrow(freed(_cutter(docs.columns, added, marks, window)), schema)


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_n_words"), b.column("_n_removed"), pa.array(sums, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return cleaned.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_n_words", "_n_removed").mapInArrow(
        task, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
