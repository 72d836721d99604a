"""Alignment of the tokens of two tokenizers on the bytes of each text, and corpus counts of linked ids.

The tokens of B on a text's bytes are intervals that never change: their sorted starts and ends are a static
interval index. Each token of A stabs it by bisection and finds the first and the last token of B that it overlaps.
A gap between two tokens of A that no token of B spans (the last one met before it comes before the first one met
after it) is a group boundary. All tokens of A and of B in a group are linked.

Documents are aligned in blocks of BLOCK_BYTES of text that never leave their task; a block has one dictionary of the
id pairs that occur in it, and its documents refer to that. So the corpus-wide counts (how many documents
hold a pair) move one row for each pair of a block instead of one for each pair of a document, and come back the same way.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.bpe import PieceEncoder, encoder
from catalith.llm.common import cut, freed, join_groups, slices

#: Text of a block (or one document), and of one pass of numpy in it.
BLOCK_BYTES, PASS_BYTES = 4 << 20, 1 << 19
#: Pieces that a process keeps of the work of tokenizer A; fewer than elsewhere, as tokenizer B and the links are in memory as well.
KEPT_PIECES = 100_000
#: Links of a group that are listed one by one; larger groups multiply the counts of their ids.
LISTED_LINKS = 1 << 16

ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, codes binary, times binary, pairs array<long>, pair_docs array<long>"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = sorted({*range(0x100)}.difference(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Tokenizer A: ids of a space and the text, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        self.coder: PieceEncoder = encoder(path, True, True, KEPT_PIECES)
        at = byte_level()
        self.raw = [b""] * self.coder.tokenizer.get_vocab_size()
        for token, i in self.coder.tokenizer.get_vocab().items():
            self.raw[i] = bytes(at[c] for c in token) if all(c in at for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.coder.encode([f" {t}" for t in texts])]


class Pieces:
    """Tokenizer B: ids of the text, before which the model itself puts a space, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        piece, is_byte = self.model.id_to_piece, self.model.is_byte
        self.raw = [bytes([int(piece(i)[1:-1], 16)]) if is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.model.encode(texts, num_threads=1)]


def groups_of(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end among the tokens of A and of B; both cover the same bytes without gaps."""
    first = np.searchsorted(end_b, start_a, side="right")  # the first token of B that ends after the token of A begins
    last = np.searchsorted(start_b, end_a, side="left") - 1  # the last one that begins before it ends
    cuts = np.flatnonzero(np.append(last[:-1] < first[1:], True)) if len(start_a) else np.zeros(0, np.int64)
    return cuts + 1, last[cuts] + 1


class Joined:
    """Whether the bytes of a text's tokens, one after the other, are the text's; for all texts of a pass at once."""

    def __init__(self, raw: list[bytes]) -> None:
        self.raw = raw
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
        every = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int64)
        size = self.size[every]
        at = np.repeat(self.start[every] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ends = np.append(0, np.cumsum(size))[np.cumsum([len(x) for x in ids], dtype=np.int64)]
        text = np.frombuffer(b"".join(texts), np.uint8)
        if np.array_equal(ends, np.cumsum([len(x) for x in texts])) and np.array_equal(self.bytes[at], text):
            return np.ones(len(ids), bool)
        return np.array([b"".join(map(self.raw.__getitem__, x.tolist())) == t for x, t in zip(ids, texts, strict=True)], bool)


class Aligner:
    """The two tokenizers of a process, and what the strings and keys of their ids need."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.joined_a, self.joined_b = Joined(self.a.raw), Joined(self.b.raw)
        self.size_a, self.size_b = self.joined_a.size, self.joined_b.size
        #: A pair of ids is a * base + b.
        self.base = len(self.b.raw)
        #: Each id with what may follow it.
        self.said = [f"{i}{after}" for i in range(max(len(self.a.raw), self.base)) for after in (",", "|", ";", "")]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text by A and by B; none if the bytes of either differ from the space and the text."""
        none = np.zeros(0, "<u4")
        live = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in live]
        raws = [f" {t}".encode() for t in some]
        same = np.ones(len(some), bool)
        found = self.a.encode(some), self.b.encode(some)
        for side, ids in zip((self.joined_a, self.joined_b), found, strict=True):
            same &= side(ids, raws)
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        for k in np.flatnonzero(same).tolist():
            out_a[live[k]], out_b[live[k]] = found[0][k], found[1][k]
        return out_a, out_b

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list[str]]:
        """For each text its counts and groups; document (its place in texts), pair and times of all its distinct links."""
        per_a, per_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in per], np.int64) for per in (per_a, per_b))
        ids_a, ids_b = (np.concatenate([np.zeros(0, "<u4"), *per]).astype(np.int64) for per in (per_a, per_b))
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cut_a, cut_b = groups_of(end_a - self.size_a[ids_a], end_a, end_b - self.size_b[ids_b], end_b)
        in_a, in_b = (np.diff(c, prepend=0) for c in (cut_a, cut_b))
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        doc = doc_a[cut_a - 1]
        links = in_a * in_b
        n_groups, n_links = (np.bincount(doc, w, len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64) for w in (None, links))
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": n_groups,
            "n_links": n_links,
            "groups": self.strings(ids_a, ids_b, cut_a, cut_b, n_a, n_b),
            **self.links(ids_a, ids_b, cut_a, cut_b, in_a, in_b, doc, links),
        }

    def strings(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each text."""
        after_a, after_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        after_a[cut_a - 1] = 1
        after_b[cut_b - 1] = 2
        ends = np.cumsum(n_b)[n_b > 0]
        after_b[ends - 1] = 3
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        group_a, group_b = (np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in (cut_a, cut_b))
        order[np.arange(len(ids_a)) + np.append(0, cut_b)[group_a]] = ids_a * 4 + after_a
        order[np.arange(len(ids_b)) + cut_a[group_b]] = ids_b * 4 + after_b
        at = np.append(0, np.cumsum(n_a + n_b)).tolist()
        return ["".join(map(self.said.__getitem__, order[i:j].tolist())) for i, j in zip(at, at[1:], strict=False)]

    def links(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, doc: np.ndarray, links: np.ndarray) -> dict[str, np.ndarray]:
        """The distinct links of each document, sorted, and how often each occurs."""
        listed = links <= LISTED_LINKS
        take = np.flatnonzero(np.repeat(listed, in_a))  # tokens of A in groups that are listed
        group = np.repeat(np.arange(len(in_a)), in_a)[take]
        times = in_b[group]
        at = np.repeat((cut_b - in_b)[group] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        space = len(self.a.raw) * self.base
        keys, n = np.unique(np.repeat(doc[group] * space + ids_a[take] * self.base, times) + ids_b[at], return_counts=True)
        parts = [(keys, n)]
        for g in np.flatnonzero(~listed).tolist():
            a, many_a = np.unique(ids_a[cut_a[g] - in_a[g] : cut_a[g]], return_counts=True)
            b, many_b = np.unique(ids_b[cut_b[g] - in_b[g] : cut_b[g]], return_counts=True)
            parts.append((np.add.outer(doc[g] * space + a * self.base, b).ravel(), np.multiply.outer(many_a, many_b).ravel()))
        if len(parts) > 1:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, back, np.concatenate([x for _, x in parts]))
        return {"doc": keys // space, "pair": keys % space, "times": n}


@functools.lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each process."""
    return Aligner(path_a, path_b)


def _smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _block(block: int, doc_ids: list[int | None], parts: list[dict], with_groups: bool) -> pa.RecordBatch:
    """The rows of a block's documents, and one row of its dictionary."""
    joined = {k: np.concatenate([p[k] for p in parts]) for k in ("n_a", "n_b", "n_groups", "n_links", "pair", "times")}
    groups = list(chain.from_iterable(p["groups"] for p in parts))
    pairs, codes = np.unique(joined["pair"], return_inverse=True)
    per_doc = np.concatenate([np.bincount(p["doc"], minlength=len(p["groups"])) for p in parts])
    ends = np.append(0, np.cumsum(per_doc)).tolist()
    codes, times = codes.astype("<u4"), joined["times"]
    n, null = len(doc_ids), [None]
    cols = [
        pa.array(np.full(n + 1, block)),
        pa.array([*doc_ids, None], pa.int64()),
        *(pa.array([*joined[k].tolist(), None], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")),
        pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] + null, pa.string()),
        pa.array((groups if with_groups else null * n) + null, pa.string()),
        pa.array([codes[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)] + null, pa.binary()),
        pa.array([_smallest(times[i:j]).tobytes() for i, j in zip(ends, ends[1:], strict=False)] + null, pa.binary()),
        pa.array([*null * n, pairs], pa.list_(pa.int64())),
        pa.array([*null * n, np.bincount(codes, minlength=len(pairs))], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ALIGNED.split(", ")])


def _task(path_a: str, path_b: str, with_groups: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block, doc_ids, parts, held = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for rows in slices(batch, limit=PASS_BYTES):
                texts = rows.column("text")
                doc_ids += rows.column("doc_id").to_pylist()
                parts.append(both.align(texts.to_pylist()))
                held += texts.nbytes
                if held >= BLOCK_BYTES:
                    yield _block(block, doc_ids, parts, with_groups)
                    block, doc_ids, parts, held = block + 1, [], [], 0
        if doc_ids:
            yield _block(block, doc_ids, parts, with_groups)

    return task


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """A row for each document, and one for the dictionary of each block (pairs is not null there); written once.

    with_groups: the documents' groups as text, too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(freed(_task(path_a, path_b, with_groups)), ALIGNED))


def pair_counts(found: DataFrame, base: int) -> DataFrame:
    """pair, n_docs (documents that hold it linked) and best (no pair of its id of A has more), from the dictionaries of aligned()."""
    uses = found.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("x")).select("x.pairs", "x.pair_docs")
    counts = uses.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_docs").alias("n_docs"))
    of_a = Window.partitionBy(F.expr(f"pair div {base}"))  # an id of A has at most the vocabulary of B beside it
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def _sums(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The sums over each document's links, from the counts of its block's dictionary."""
    code = found.column("code").to_numpy()
    count, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    count[code] = found.column("n_docs").to_numpy()
    best[code] = found.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at = np.frombuffer(codes, "<u4")
        n = np.frombuffer(times, f"<u{len(times) // len(at)}").astype(np.int64) if len(at) else np.zeros(0, np.int64)
        n_best.append(int(n @ best[at]))
        count_sum.append(int(n @ count[at]))
    more = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    names = [x.split()[0] for x in COUNTED.split(", ")]
    return pa.table([more[k] if k in more else docs.column(k) for k in names], names=names)


def token_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    path_a: a byte-level tokenizer, of a space and the text; path_b: a SentencePiece model that itself puts a space before the text.
    Strings of special tokens are ordinary text. Texts that are null, empty or that a tokenizer does not give back byte
    by byte have zeros and an empty groups_sha256. Null and repeated doc_ids: each row is a document. Ties: all pairs
    with the highest count of an id of A are best. A text of any length is aligned whole, in a block of its own if it is
    long. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    found = aligned(docs, path_a, path_b)
    base = vocabulary_size(path_b)
    uses = found.where("pairs is not null").select("block", F.posexplode("pairs").alias("code", "pair"))
    looked_up = join_groups(uses, pair_counts(found, base), ["pair"]).select("block", "code", "n_docs", "best")
    rows = found.where("pairs is null").select(F.col("block").alias("in_block"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
    return rows.groupBy("in_block").cogroup(looked_up.groupBy("block")).applyInArrow(_sums, COUNTED)


def vocabulary_size(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def link_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, n_docs and best of every pair of ids that some document holds linked."""
    base = vocabulary_size(path_b)
    return pair_counts(aligned(docs, path_a, path_b), base).select(F.expr(f"pair div {base}").alias("a"), F.expr(f"pair % {base}").alias("b"), "n_docs", "best")
