"""Shared helpers of the corpus operators: session, lineage cuts, Arrow batches and word hashes.

Word hashes are numpy over the UTF-8 buffer of an Arrow batch. A word is a run of bytes that are not
ASCII white space (``\\x20``, ``\\x09``-``\\x0D``), so the words are exactly ``[^\\x20\\x09-\\x0D]+``.
All hashes are fixed functions of the bytes: a task that runs again gives the same rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.sources.stores import work_folder

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
SLICE_BYTES = 1 << 18

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd, so invertible modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the cluster's checkpoint folder; what follows reads it from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the session is local (tests, a laptop) is a
    temporary one made. The files are reliable: they outlive any executor.
    """
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share."""
    return work_folder(spark)


def freed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, after which its process gives back the memory that it no longer uses; Spark keeps the process for further tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it new among the columns of df."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch with at most limit bytes of text each, or one row; a null text becomes an empty one."""
    at = batch.schema.get_field_index(column)
    text = batch.column(at).fill_null("")
    batch = batch.set_column(at, pa.field(column, text.type), text)
    ends = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)
    ends = ends[text.offset : text.offset + len(text) + 1].astype(np.int64)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and where each row begins in it (with the end at last)."""
    large = pa.types.is_large_string(text.type)
    ends = np.frombuffer(text.buffers()[1], np.int64 if large else np.int32)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[int(ends[0]) : int(ends[-1])], (ends - ends[0]).astype(np.int64)


def parts_of(data: np.ndarray, edges: np.ndarray) -> pa.DictionaryArray:
    """The distinct parts of data between edges (its end at last), and which of them each part is."""
    kind, width = (pa.string(), np.int32) if len(data) < 1 << 31 else (pa.large_string(), np.int64)
    parts = pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(np.ascontiguousarray(data))])
    return parts.dictionary_encode()


def runs(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all items of runs, one run after the other, and where each run begins among them (with the end at last)."""
    ends = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    return np.arange(ends[-1]) + np.repeat(start - ends[:-1], length), ends


def joined_runs(raw: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit ids of raw[i] for each i of which, and where each begins among them (with the end at last)."""
    length = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    at, ends = runs((np.cumsum(length) - length)[which], length[which])
    return np.frombuffer(b"".join(raw), "<u4")[at], ends


_KEPT_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, size at least; a process keeps those for a slice."""
    kept = _KEPT_POWERS.get(base)
    if kept is None or len(kept[0]) < size:
        one = np.ones(1, np.uint64)
        n = 1 << max(16, int(size).bit_length())  # a power of two, so that it seldom grows
        kept = tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
        if n <= 2 * SLICE_BYTES:
            _KEPT_POWERS[base] = kept
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row for each of keys, so that a hot key is split among tasks.

    groups is aggregated by the keys, so Spark would join where its aggregation lies, and can't split a shuffle that
    an aggregation reads. A further key makes both sides shuffles of the join alone, which AQE splits where they
    are skewed.
    """
    further = F.xxhash64(*keys)
    return rows.withColumn("_further", further).join(groups.withColumn("_further", further), [*keys, "_further"], how).drop("_further")


class Words:
    """The words of all rows of a slice.

    start, end: byte places in data; row: where each row's words begin (with the end at last);
    hash: 64 bits for each word.
    """

    def __init__(self, text: pa.Array, lower: bool = False, kind: np.ndarray | None = None):
        """kind: a class for each byte; a word is a run of one class other than 0. Default: not white space."""
        self.data, self.byte_row = utf8(text)
        data = ASCII_LOWER[self.data] if lower else self.data
        n = len(data)
        kinds = (~ASCII_SPACE).astype(np.uint8)[data] if kind is None else kind[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = kinds[1:] != kinds[:-1]
        edge[self.byte_row] = True
        cuts = np.flatnonzero(edge)
        first, last = cuts[:-1], cuts[1:]
        real = kinds[first] > 0 if n else np.zeros(0, bool)
        self.start, self.end = (first[real], last[real]) if n else (np.zeros(0, np.int64),) * 2
        up, down = powers(_BYTE_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length * np.uint64(0xA0761D6478BD642F))
        self.row = np.searchsorted(self.start, self.byte_row)
        self._sum: np.ndarray | None = None
        self._bytes = total

    def head_hash(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than size bytes, and a hash of the first size bytes of each."""
        at = np.flatnonzero(self.end - self.start > size)
        start = self.start[at]
        down = powers(_BYTE_BASE, len(self.data))[1]
        return at, mix((self._bytes[start + size] - self._bytes[start]) * down[start] + np.uint64(size * 0x5851F42D4C957F2D & (1 << 64) - 1))

    def span_hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The hash of each run of words, from its first word and number of words."""
        up, down = powers(_WORD_BASE, len(self.hash))
        if self._sum is None:
            self._sum = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * up[: len(self.hash)], out=self._sum[1:])
        end = start + length
        return mix((self._sum[end] - self._sum[start]) * down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, those across rows included."""
        return self.span_hash(np.arange(max(0, len(self.hash) - k + 1)), k)

    def inside(self, k: int) -> np.ndarray:
        """The first words of all runs of k words that lie in one row."""
        n = len(self.hash)
        row_end = np.repeat(self.row[1:], np.diff(self.row))
        return np.flatnonzero(np.arange(n) + k <= row_end)


def prefix_sums(df: DataFrame, order: list[str], counts: dict[str, str]) -> DataFrame:
    """Adds for each item of counts (new column: counted column) the sum over all rows before it in order.

    Rows are dealt by range of order, and where they are equal in it (null or repeated ids) by where they stand in df, so no
    key fills a task; only one sum for each range is gathered, so what one task or the driver holds is bounded by the
    number of ranges. Null keys come first.
    """
    spark = df.sparkSession
    by = [*order, "_tie"]
    dealt = cut(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_sum_{new}") for new, c in counts.items())).collect()
    before, running = [], dict.fromkeys(counts, 0)
    for r in sorted(totals, key=lambda r: r["_range"]):
        before.append((r["_range"], *running.values()))
        running = {new: running[new] + r[f"_sum_{new}"] for new in counts}
    names = ", ".join(["_range int", *(f"_before_{new} long" for new in counts)])
    dealt = dealt.join(F.broadcast(spark.createDataFrame(before, names)), "_range")  # a row for each range
    w = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(
        *df.columns,
        *((F.col(f"_before_{new}") + F.coalesce(F.sum(c).over(w), F.lit(0))).cast("long").alias(new) for new, c in counts.items()),
    )
