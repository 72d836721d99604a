"""Token ids in length-delimited binary record files, with an offset index for shuffled reads.

A record is: length of the payload (8 bytes, little-endian), masked checksum of those 8 bytes (4),
the payload, masked checksum of the payload (4). The payload is the ids of one document, as
unsigned 16-bit integers if the vocabulary allows, else 32-bit. The checksum is CRC-32, masked as
((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32, so that a checksum of data which holds checksums stays useful.

Tasks write through the file system of the folder's address, each attempt to a file of its own name;
the index, a Parquet table, commits with the job and names only the files of the attempts that counted.
So a lost executor or a second attempt leaves a stray file that no reader opens, never a torn one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.bpe import encoder
from catalith.llm.common import freed, prefix_sums, shared_folder, slices

INDEX = "doc_id long, part int, at long, file string, offset long, width int, n_tokens long"
READ = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return ((((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF).to_bytes(4, "little")


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length), payload, masked(payload)))


def unframe(read: Callable[[int], bytes]) -> bytes:
    """The payload of the record that read is at; ValueError if it is damaged."""
    head = read(12)
    if len(head) != 12 or masked(head[:8]) != head[8:]:
        raise ValueError("damaged record length")
    n = int.from_bytes(head[:8], "little")
    payload, tail = read(n), read(4)
    if len(payload) != n or masked(payload) != tail:
        raise ValueError("damaged record")
    return payload


def _file_system(folder: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _writer(folder: str, tokenizer: str, spaced: bool, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, file = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.records"
        coder = encoder(tokenizer, spaced)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, path = _file_system(folder)
        out, at, offset = None, 0, 0
        for batch in batches:
            for rows in slices(batch, limit=1 << 22):
                out = out or store.open_output_stream(f"{path}/{file}")
                offsets, tokens = [], []
                text = rows.column("text")
                for ids in coder.encode_batch(text) if spaced else (np.frombuffer(x, "<u4") for x in coder.encode(text.to_pylist())):
                    record = frame(np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes())
                    out.write(record)
                    offsets.append(offset)
                    tokens.append(len(ids) + 1)
                    offset += len(record)
                n = len(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.arange(at, at + n)),
                        pa.array([file] * n),
                        pa.array(offsets, pa.int64()),
                        pa.array(np.full(n, width, np.int32)),
                        pa.array(tokens, pa.int64()),
                    ],
                    names=["doc_id", "part", "at", "file", "offset", "width", "n_tokens"],
                )
                at += n
        if out:
            out.close()

    return task


def write_token_files(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, folder: str | None = None) -> str:
    """Writes docs in ascending doc_id order and returns the folder: record files, and the table index.

    The order of the documents is that of (part, at) in the index. Null or empty text: the end id alone.
    Null doc_ids come first. Rows with one doc_id follow one another, as they stand in docs; null and repeated doc_ids are dealt
    among files as well. A text of any length is one record. Other columns, whatever their names, are not read. An
    empty table: an empty index.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    store, path = _file_system(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(freed(_writer(folder, tokenizer, spaced, end_id)), INDEX).write.parquet(f"{folder}/index")
    return folder


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, part, at, n_tokens and ids_crc32 of each record, all of them from the files' bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(folder)
        name, file = None, None
        for b in batches:
            tokens, crcs = [], []
            for f, offset, width in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("width").to_pylist(), strict=True):
                if f != name:
                    if file:
                        file.close()
                    name, file = f, store.open_input_file(f"{path}/{f}")
                if file.tell() != offset:
                    file.seek(offset)
                ids = np.frombuffer(unframe(file.read), f"<u{width}").astype("<u4")
                tokens.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), b.column("at"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
            )
        if file:
            file.close()

    at_file = index.repartition("file").sortWithinPartitions("file", "offset")  # index rows only; a file is read front to back
    return at_file.select("doc_id", "part", "at", "file", "offset", "width").mapInArrow(task, READ)


def token_file_digest(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from files written and read back."""
    folder = write_token_files(docs, tokenizer, spaced, end_id)
    back = read_token_files(docs.sparkSession.read.parquet(f"{folder}/index"), folder)
    return prefix_sums(back, ["part", "at"], {"start": "n_tokens"}).select("doc_id", "start", "n_tokens", "ids_crc32")
