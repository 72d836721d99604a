"""Packing by power-of-two decomposition: every piece is a sequence, so none crosses documents or is padded.

The length of a document in tokens is written as whole sequences of the longest length and then its
binary digits from the highest down (Pouransari et al. 2024). Pieces of equal length form a bucket;
sequences are numbered bucket by bucket, longest first, and in a bucket by document and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.bpe import encoder
from catalith.llm.common import cut, freed, prefix_sums, slices


def lengths(n: int, longest: int) -> list[int]:
    """The pieces of n tokens; longest is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << j for j in range(longest.bit_length() - 2, -1, -1) if rest >> j & 1]


def _pieces(tokenizer: str, spaced: bool, end_id: int, longest: int, with_ids: bool, kept_pieces: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = end_id.to_bytes(4, "little")
    kinds = [("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    kind = pa.list_(pa.struct(kinds))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced, most=kept_pieces).encode
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                pieces, tokens = [], []
                for ids in encode(part.column("text").to_pylist()):
                    view, at, row = memoryview(ids + end), 0, []
                    tokens.append(len(view) // 4)
                    for n in lengths(tokens[-1], longest):
                        raw = view[4 * at : 4 * (at + n)]
                        row.append({"length": n, "ids_crc32": zlib.crc32(raw)} | ({"ids": raw.cast("i").tolist()} if with_ids else {}))
                        at += n
                    pieces.append(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(pieces, kind)], names=["doc_id", "doc_tokens", "pieces"]
                )

    return task


def pack(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, longest: int = 2048, with_ids: bool = False, kept_pieces: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), and ids if asked for.

    The end id closes each document. Null or empty text: the end id alone, one piece of length 1. Null
    doc_id: packed as well, before the others. Repeated rows: each is packed; rows of one doc_id follow one another as they
    stand in docs. A text of any length is packed whole. Other columns, whatever their names, are not read. An empty table
    gives no pieces. kept_pieces: what a process keeps of the encoder's work; the result is the same.
    """
    ids = ", ids array<int>" if with_ids else ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        freed(_pieces(tokenizer, spaced, end_id, longest, with_ids, kept_pieces)),
        f"doc_id long, doc_tokens long, pieces array<struct<length: long, ids_crc32: long{ids}>>",
    )
    sizes = [1 << j for j in range(longest.bit_length() - 1, -1, -1)]
    n = F.col("doc_tokens")
    in_bucket = {s: F.floor(n / s) if s == longest else F.floor(n / s) % 2 for s in sizes}
    counted = cut(rows).withColumns({f"_n{s}": in_bucket[s].cast("long") for s in sizes})  # the texts are tokenized once
    counted = prefix_sums(counted, ["doc_id"], {f"_b{s}": f"_n{s}" for s in sizes})
    totals = counted.agg(*(F.coalesce(F.sum(f"_n{s}"), F.lit(0)).alias(f"{s}") for s in sizes)).first()
    first, base = {}, 0
    for s in sizes:
        first[s] = base
        base += totals[f"{s}"]
    whole = F.lit(longest).cast("long")
    places = counted.select("doc_id", "doc_tokens", *(f"_b{s}" for s in sizes), F.posexplode("pieces").alias("_at", "_piece"))
    length = F.col("_piece.length")
    number = F.coalesce(*(F.when(length == s, F.lit(first[s]) + F.col(f"_b{s}") + (F.col("_at") if s == longest else 0)) for s in sizes))
    start = F.when(length == longest, F.col("_at") * whole).otherwise(F.floor(n / (length * 2)) * (length * 2))
    return places.select(
        "doc_id",
        start.cast("long").alias("start"),
        length.alias("length"),
        F.col("_piece.ids_crc32").alias("ids_crc32"),
        "doc_tokens",
        number.cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *([F.col("_piece.ids").alias("ids")] if with_ids else []),
    )
