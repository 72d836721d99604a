"""Removal of repeated runs of lines, by a suffix array over line ids built with distributed prefix doubling.

A document is the sequence of its lines with a word; a line's id is a 64-bit hash of it, and the order of ids is
the alphabet's. The array is a table of all suffixes (doc_id, pos) with their ranks.

1.  A suffix's first rank is the number of suffixes whose first line is smaller. In round k the suffixes that still
    share a rank are sorted by (rank, rank of the suffix k lines on), and a rank grows by the members of its
    group that the sort puts before (Manber, Myers 1993; Larsson, Sadakane 2007). Each sort is a range
    partitioning with the place as the last key, so a group of any size is dealt among tasks; for a group that spans
    ranges, the driver carries one boundary for each range. Suffixes alone in their group keep their rank, and
    documents without others leave, so the rounds are as many as the logarithm of the longest repeated run.
2.  In the order of the finished array, neighbours that fell apart in round k share k lines at least and fewer than
    2 k. The longest common prefix is then read from the two documents' line ids, k at most; only where the lines
    before the neighbours differ, since else it is one less than that of the suffix before (Karkkainen, Manzini,
    Puglisi 2009).
3.  Neighbours that share min_lines lines or more form an interval: a repeated run with all its places. Every place
    but the earliest (smaller doc_id, or earlier in the document) is a later copy and is deleted; together these
    are the maximal repeated runs. A single line of min_words words is a run too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import ASCII_SPACE, Words, cut, free_name, freed, join_groups, signed, slices

_LINE = np.ones(256, np.uint8)
_LINE[10] = 0
_KEPT = "doc_id long, pos int, left int, before long, long boolean, rank long, low int"
#: What a round's sort gives: the keys, and where a suffix stands in its group, as far as its range knows.
_SORTED = f"{_KEPT}, next long, at long, offset long, shared boolean"
_KEYS = ["rank", "next", "doc_id", "pos"]


def _line_words(w: Words) -> np.ndarray:
    """How many words each line has that isn't empty."""
    ink = ~ASCII_SPACE[w.data]
    opens = ink.copy()
    opens[1:] &= ~ink[:-1]
    count = np.concatenate([[0], np.cumsum(opens)])
    starts_inside = np.zeros(len(w.start), np.int64)  # a line begins after a line feed or at a text's first byte
    edge = (w.start > 0) & (len(ink) > 0)
    starts_inside[edge] = ink[w.start[edge]] & ink[w.start[edge] - 1]
    return count[w.end] - count[w.start] + starts_inside


def _sequences(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, and for its lines with a word the ids and whether they are long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), kind=_LINE)
                words = _line_words(w)
                full = np.flatnonzero(words)
                at = pa.array(np.searchsorted(full, w.row).astype(np.int32))
                names = pa.ListArray.from_arrays(at, pa.array(signed(w.hash[full])))
                long = pa.ListArray.from_arrays(at, pa.array(words[full] >= min_words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), names, long], names=["doc_id", "names", "long"])

    return task


def sequences(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents as sequences of line ids: doc_id, names, long. The texts are read once."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return cut(ids.mapInArrow(freed(_sequences(min_words)), "doc_id long, names array<long>, long array<boolean>"))


def _held_back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batches with the last row of each moved to the front of the next one, and whether it is the last batch."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if b.num_rows:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            yield b, False
            held = b.slice(b.num_rows - 1)
    if held is not None:
        yield held, True


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in the order of _KEYS. at: place in the group of the rank; offset: of the first equal (rank, next); shared: not alone.

    Equal rows, which are of repeated documents, count once. Two rows without doc_id (pos -1 and -2) say where the range begins and ends.
    """
    keys, begin = [None] * 4, None
    count = offset = 0
    for b, last in _held_back(batches):
        cols = [b.column(k).fill_null(-1).to_numpy(zero_copy_only=False) for k in _KEYS]
        same = [np.concatenate([[keys[j] is not None and c[0] == keys[j]], c[1:] == c[:-1]]) for j, c in enumerate(cols)]
        again = same[0] & same[1] & same[2] & same[3]
        if again.any():
            kept = np.flatnonzero(~again)
            b, cols, same = b.take(pa.array(kept)), [c[kept] for c in cols], [x[kept] for x in same]
        n = len(cols[0]) if last else len(cols[0]) - 1
        if not len(cols[0]):
            continue
        here = np.arange(len(cols[0]))
        new_rank, new_pair = ~same[0], ~(same[0] & same[1])
        start = np.maximum.accumulate(np.where(new_rank, here, -1))
        at = np.where(start >= 0, here - start, count + here)
        opened = np.maximum.accumulate(np.where(new_pair, here, -1))
        offsets = np.where(opened >= 0, at[opened], offset)
        shared = ~new_pair
        shared[:-1] |= ~new_pair[1:]
        if n:
            out = [*(b.column(k) for k in ("doc_id", "pos", "left", "before", "long", "rank", "low")), pa.array(cols[1]), pa.array(at), pa.array(offsets), pa.array(shared)]
            yield pa.RecordBatch.from_arrays([c.slice(0, n) for c in out], names=[x.split()[0] for x in _SORTED.split(", ")])
            begin = begin or (cols[0][0], cols[1][0])
            keys, count, offset = [c[n - 1] for c in cols], int(at[n - 1]) + 1, int(offsets[n - 1])
    if begin:
        names = [x.split()[0] for x in _SORTED.split(", ")]
        edge = {"pos": ([-1, -2], pa.int32()), "rank": ([begin[0], keys[0]], pa.int64()), "next": ([begin[1], keys[1]], pa.int64()), "at": ([0, count - 1], pa.int64()), "offset": ([0, offset], pa.int64())}
        none = {"doc_id": pa.int64(), "left": pa.int32(), "before": pa.int64(), "long": pa.bool_(), "low": pa.int32(), "shared": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(*edge[x]) if x in edge else pa.nulls(2, none[x]) for x in names], names=names)


def _round(moving: DataFrame, rest: DataFrame | None, k: int) -> DataFrame:
    """moving(_KEPT, next) with their new ranks, and rest as it is: _KEPT, shared, active, moved."""
    one = moving.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_in_groups, _SORTED).withColumn("_range", F.spark_partition_id())
    if rest is not None:
        one = one.unionByName(rest.select(*(x.split()[0] for x in _KEPT.split(", "))), allowMissingColumns=True)
    one = cut(one)
    ends = sorted(one.where("doc_id is null").select("_range", "pos", "rank", "next", "at", "offset").collect(), key=lambda r: (r["_range"], -r["pos"]))  # two rows for each range
    bounds = list(zip(ends[::2], ends[1::2], strict=True))
    rows, rank, following, count, offset = [], None, None, 0, 0
    for i, (lo, hi) in enumerate(bounds):
        carried = count if lo["rank"] == rank else 0
        joins = rank is not None and (lo["rank"], lo["next"]) == (rank, following)
        then = bounds[i + 1][0] if i + 1 < len(bounds) else None
        goes_on = then is not None and (then["rank"], then["next"]) == (hi["rank"], hi["next"])
        rows.append((lo["_range"], lo["rank"], lo["next"], carried, offset if joins else None, hi["rank"], hi["next"], goes_on))
        alone = lo["rank"] == hi["rank"]
        offset = offset if joins and alone and lo["next"] == hi["next"] else hi["offset"] + carried * alone
        rank, following, count = hi["rank"], hi["next"], hi["at"] + 1 + carried * alone
    named = "_range int, lo_rank long, lo_next long, carried long, joined long, hi_rank long, hi_next long, goes_on boolean"
    placed = one.where("doc_id is not null").join(F.broadcast(one.sparkSession.createDataFrame(rows, named)), "_range", "left")
    first = (F.col("rank") == F.col("lo_rank")) & (F.col("next") == F.col("lo_next")) & F.col("joined").isNotNull()
    last = (F.col("rank") == F.col("hi_rank")) & (F.col("next") == F.col("hi_next")) & F.col("goes_on")
    offset = F.when(first, F.col("joined")).otherwise(F.col("offset") + F.when(F.col("rank") == F.col("lo_rank"), F.col("carried")).otherwise(0))
    moved = F.col("_range").isNotNull()
    shared = F.coalesce(F.col("shared") | first | last, F.lit(False))
    return placed.select(
        *("doc_id", "pos", "left", "before", "long"),
        F.when(moved, F.col("rank") + offset).otherwise(F.col("rank")).alias("rank"),
        F.when(moved & (offset > 0), k).otherwise(F.col("low")).cast("int").alias("low"),
        shared.alias("shared"),
        (shared & ((F.col("next") >= 0) if k else F.lit(True))).alias("active"),  # without a next line, the two are equal to their ends
        moved.alias("moved"),
    )


def suffix_array(lines: DataFrame) -> DataFrame:
    """doc_id, pos, left, before, long, rank, low of each suffix whose first line another suffix begins with.

    rank: how many suffixes of the corpus are smaller; equal ones share it. low: the power of two of lines that the
    suffix shares with the one before it in the array, at least, where their ranks differ. lines: of sequences.
    """
    k, found, rest = 0, [], None
    moving = lines.select("doc_id", "names", F.posexplode(F.arrays_zip("names", "long")).alias("pos", "line")).select(
        "doc_id",
        "pos",
        (F.size("names") - F.col("pos")).alias("left"),
        F.get("names", F.col("pos") - 1).alias("before"),
        F.col("line.long").alias("long"),
        F.lit(0).cast("long").alias("rank"),
        F.lit(0).alias("low"),
        F.col("line.names").alias("next"),
    )
    while True:
        state = _round(moving, rest, k)
        found.append(state.where("moved and shared" if not k else "moved"))
        if state.where("active").isEmpty():
            break
        k = 2 * k or 1
        own = Window.partitionBy("doc_id")  # a document's own lines
        ahead = state.withColumn("next", F.coalesce(F.max("rank").over(own.orderBy("pos").rangeBetween(k, k)), F.lit(-1))).withColumn("_live", F.max("active").over(own))
        moving, rest = ahead.where("active").drop("shared", "active", "moved", "_live"), ahead.where("_live and not active")
    last = reduce(DataFrame.unionByName, found).groupBy("doc_id", "pos")  # ranks and common prefixes only grow
    return last.agg(*(F.max(k).alias(k) for k in ("left", "before", "long", "rank", "low")))


def _beside(depths: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one range in the order of the array, with the row before each and, for each depth, the interval: the rank of its first row.

    What lies before the range is not known: its first row has no row before it, and its first intervals are -1.
    """
    taken = ("doc_id", "pos", "left", "before", "rank")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        open_ = [-1] * len(depths)
        for b in batches:
            if not b.num_rows:
                continue
            here = np.arange(b.num_rows)
            back = pa.array(here - 1, mask=here == 0)
            cols = [b.column(k).take(back) for k in taken]
            if before is not None:
                cols = [pa.concat_arrays([before.column(k), c.slice(1)]) for k, c in zip(taken, cols, strict=True)]
            rank, low = b.column("rank").to_numpy(), b.column("low").to_numpy()
            changes = rank != cols[-1].fill_null(-1).to_numpy(zero_copy_only=False)
            changes[0] &= before is not None
            blocks = []
            for j, d in enumerate(depths):
                start = np.maximum.accumulate(np.where(changes & (low < d), here, -1))
                blocks.append(np.where(start >= 0, rank[start], open_[j]))
                open_[j] = int(blocks[-1][-1])
            names = [*b.schema.names, "p_doc", "p_pos", "p_left", "p_before", "p_rank", *(f"in_{d}" for d in depths)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, *map(pa.array, blocks)], names=names)
            before = b.slice(b.num_rows - 1)

    return task


def neighbours(array: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """The rows of array with the row before each (p_doc, p_pos, p_left, p_before, p_rank) and its intervals.

    in_d for a depth d, a power of two: equal for all suffixes that share d lines, if they have as many.
    """
    order, ins = ["rank", "doc_id", "pos"], [f"in_{d}" for d in depths]
    columns = [x.split()[0] for x in _KEPT.split(", ")]
    schema = f"{_KEPT}, p_doc long, p_pos int, p_left int, p_before long, p_rank long, " + ", ".join(f"{x} long" for x in ins)
    rows = array.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_beside(depths), schema)
    rows = cut(rows.withColumn("_range", F.spark_partition_id()))
    ends = rows.groupBy("_range").agg(F.min(F.struct("rank", "low")).alias("lo"), F.max(F.struct("rank", "doc_id", "pos", "left", "before", *ins)).alias("hi"))
    bounds, hi, carried = [], None, [-1] * len(depths)
    for r in sorted(ends.collect(), key=lambda r: r["_range"]):  # a row for each range
        rank, low = r["lo"]
        opens = hi is None or hi["rank"] != rank
        carried = [rank if opens and low < d else c for d, c in zip(depths, carried, strict=True)]
        bounds.append((r["_range"], *((hi["doc_id"], hi["pos"], hi["left"], hi["before"], hi["rank"]) if hi else (None,) * 5), *carried))
        hi = r["hi"]
        carried = [c if hi[x] == -1 else hi[x] for x, c in zip(ins, carried, strict=True)]
    named = "_range int, e_doc long, e_pos int, e_left int, e_before long, e_rank long, " + ", ".join(f"e_{x} long" for x in ins)
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, named)), "_range", "left")
    opens = F.col("p_doc").isNull()
    return rows.select(
        *columns,
        *(F.when(opens, F.col(f"e_{k}")).otherwise(F.col(f"p_{k}")).alias(f"p_{k}") for k in ("doc", "pos", "left", "before", "rank")),
        *(F.when(F.col(x) == -1, F.col(f"e_{x}")).otherwise(F.col(x)).alias(x) for x in ins),
    )


def common_prefixes(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, pos, p_doc, p_pos and lcp, the lines that both begin with, for the neighbours rows; lines: of sequences."""
    tie = F.coalesce(F.col("rank") == F.col("p_rank"), F.lit(False))
    goes_on = F.coalesce(F.col("before") == F.col("p_before"), F.lit(False))
    known = F.when(tie, F.col("left")).when(F.col("low") < 2, F.col("low"))
    rows = rows.select("doc_id", "pos", "p_doc", "p_pos", "low", known.alias("known"), goes_on.alias("goes_on"))
    names = lines.groupBy("doc_id").agg(F.max("names").alias("names"))
    part = lambda at: F.slice("names", F.col(at) + F.col("low") + 1, F.col("low"))
    asked = rows.where("known is null and not goes_on").select("doc_id", "pos", "low", "p_doc", "p_pos")
    asked = asked.join(names, "doc_id").withColumn("here", part("pos")).drop("names")
    asked = asked.join(names.withColumnRenamed("doc_id", "p_doc"), "p_doc").withColumn("there", part("p_pos"))
    differs = F.array_position(F.zip_with("here", "there", lambda x, y: x == y), F.lit(False)).cast("int")
    read = asked.select("doc_id", "pos", (F.col("low") + F.when(differs > 0, differs - 1).otherwise(F.least(F.size("here"), F.size("there")))).alias("read"))
    rows = rows.join(read, ["doc_id", "pos"], "left").withColumn("known", F.coalesce("known", "read"))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a document's own lines
    lcp = F.coalesce("known", F.last(F.col("known") + F.col("pos"), ignorenulls=True).over(so_far) - F.col("pos"))
    return rows.select("doc_id", "pos", "p_doc", "p_pos", lcp.alias("lcp"))


def _cutter(names: list[str], added: list[str], marks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was_null, done = batch.column("text").is_null().to_pylist(), 0
            for part in slices(batch):
                w = Words(part.column("text"), kind=_LINE)
                full, texts, numbers = _line_words(w) > 0, [], []
                for i, at in enumerate(part.column(marks)):
                    a, b = int(w.byte_row[i]), int(w.byte_row[i + 1])
                    raw, lines = w.data[a:b].tobytes(), np.arange(w.row[i], w.row[i + 1])
                    lines = lines[full[lines]]
                    gone = np.zeros(len(lines), bool)
                    if at.is_valid:
                        for j, d in zip(at.values.field("pos").to_numpy(), at.values.field("n").to_numpy(), strict=True):
                            gone[j : j + d] = True
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    runs = turn[1::2] - turn[::2]
                    numbers.append((len(lines), int(gone.sum()), len(runs), int(runs.max(initial=0))))
                    if gone.any():
                        keep, last = [], 0
                        for j in np.flatnonzero(gone):
                            start, end = int(w.start[lines[j]]) - a, int(w.end[lines[j]]) - a + 1  # with its line end
                            keep.append(raw[last:start])
                            last = min(end, len(raw))
                        raw = b"".join([*keep, raw[last:]])
                    texts.append(None if was_null[done + i] else raw.decode())
                cols = [pa.array(texts, pa.string()) if k == "text" else part.column(k) for k in names]
                cols += [pa.array([x[j] for x in numbers], pa.int64()) for j in range(len(added))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])
                done += len(part)

    return task


def line_dedup(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """docs without the later copies of repeated runs: min_lines lines (a power of two) or more, or a line of min_words words or more.

    Adds _n_lines (lines with a word), _n_removed_lines, _n_runs, _longest_run, and _longest_match: the
    most lines that a suffix of the document begins with like any other suffix (0: no line is shared). Lines
    are compared as they are, without the line feed; blank lines are not counted, do not interrupt a run and stay.
    Judged on the input, not on what is left. Of equal runs the one in the smallest doc_id stays, in one document
    the first. Null text: stays null. Null doc_id: the row is kept as it is and is no source. Rows that
    share a doc_id count as one document. A text of any length is read whole. Other columns pass through, whatever
    their names. An empty table gives an empty result.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    depths = (1, min_lines) if min_lines > 1 else (1,)
    lines = sequences(docs, min_words)
    rows = cut(neighbours(suffix_array(lines), depths))
    inside = F.array_compact(F.array(*(F.when((F.col("left") >= d) & ((F.lit(d) == min_lines) | F.col("long")), F.struct(F.lit(d).alias("n"), F.col(f"in_{d}").alias("interval"))) for d in depths)))
    copies = rows.select("doc_id", "pos", F.explode(inside).alias("_")).select("doc_id", "pos", "_.n", "_.interval")
    place = F.struct("doc_id", "pos")
    groups = copies.groupBy("n", "interval").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = join_groups(copies, groups, ["n", "interval"]).where(place > F.col("first"))
    pairs = common_prefixes(lines, rows)
    longest = pairs.select("doc_id", "lcp").unionByName(pairs.where("p_doc is not null").select(F.col("p_doc").alias("doc_id"), "lcp"))
    marks = longest.select("doc_id", "lcp", F.lit(None).cast("struct<pos: int, n: int>").alias("mark")).unionByName(later.select("doc_id", F.lit(None).cast("int").alias("lcp"), F.struct("pos", "n").alias("mark")))
    of, at, match = (free_name(docs, x) for x in ("_of", "_at", "_longest_match"))
    found = marks.groupBy(F.col("doc_id").alias(of)).agg(F.coalesce(F.max("lcp"), F.lit(0)).cast("long").alias(match), F.collect_set("mark").alias(at))
    out = docs.join(found, docs["doc_id"].cast("long") == F.col(of), "left").drop(of)
    out = out.withColumn(match, F.coalesce(match, F.lit(0).cast("long")))
    names, added = [*docs.columns, match], [free_name(docs, k) for k in ("_n_lines", "_n_removed_lines", "_n_runs", "_longest_run")]
    schema = out.drop(at).select("*", *(F.lit(0).cast("long").alias(k) for k in added)).schema
    return out.select(*names, at).mapInArrow(freed(_cutter(names, added, at)), schema)


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_run, longest_match and the SHA-256 of the kept text (null: of the empty one)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [hashlib.sha256((x or "").encode()).hexdigest() for x in b.column("text").to_pylist()]
            yield b.drop_columns(["text"]).append_column("kept_sha256", pa.array(sums, pa.string()))

    given = {"_n_lines": "n_lines", "_n_removed_lines": "n_removed", "_n_runs": "n_runs", "_longest_run": "longest_run", "_longest_match": "longest_match"}
    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(k).alias(v) for k, v in given.items())]
    return cleaned.select("text", *cols).mapInArrow(task, "doc_id long, " + ", ".join(f"{v} long" for v in given.values()) + ", kept_sha256 string")
