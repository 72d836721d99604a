"""SentencePiece encoding and decoding with forward states shared among words with a common beginning.

A text is cut into words wherever two bytes meet that stand side by side in no piece of the vocabulary, so no piece crosses these
cuts: before a space (its mark opens a word), around line feeds, mostly before marks, and where letters are strange
to each other. Each distinct word of a slice is looked up once. Those that are new are sorted, so that they
form a trie in depth-first order; the forward state of every prefix is kept on a stack as long as the next word
still begins with it.

For a model of the unigram kind the state of a prefix is Viterbi's: the largest sum of scores of its segmentations, and
the piece that ends the best one (Viterbi). The public model is of the BPE kind, and the largest sum would not
give its segmentation: the forward recurrence is therefore the one of BPE, where the segmentation of a prefix
ends with exactly one piece, the one that is compatible with the last piece of the prefix before it
(two pieces are compatible if merging their joined characters gives just these two; Codec). It has the same
shape, one state for each prefix that depends only on shorter prefixes. Both give the library's ids.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import freed, joined_runs, parts_of, runs, slices, utf8

MARK = "▁"
#: Words, and pairs of pieces, whose results a process keeps.
CACHE_WORDS, CACHE_PAIRS = 450_000, 1_000_000


def word_cuts(data: np.ndarray, rows: np.ndarray, meets: np.ndarray) -> np.ndarray:
    """Places in the bytes of texts between two that don't meet, with the rows' beginnings and the end."""
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = ~meets.ravel()[data[:-1].astype(np.intp) << 8 | data[1:]]
    edge[rows] = True
    edge[[0, len(data)]] = True
    return np.flatnonzero(edge)


class Codec:
    """Encodes and decodes with the pieces of a SentencePiece BPE model with byte fallback, whose texts are not normalized."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        self.id: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        for i in size:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.id[piece], self.rank[piece] = i, -model.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        if any(re.search(rf"[^{MARK}]{MARK}|.\n|\n.", p, re.DOTALL) for p in self.id):
            raise ValueError("a piece crosses the end of a word")
        #: Marked words of a text; word_cuts cuts at their beginnings too.
        self.words = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        #: Whether a piece has two bytes side by side, or they may be of one character; no piece crosses a place between others.
        self.meets = np.zeros((256, 256), bool)
        self.meets[:, 0x80:0xC0] = True
        for i in self.id.values():
            raw = np.frombuffer(self.raw[i], np.uint8)
            self.meets[raw[:-1], raw[1:]] = True
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_length = np.fromiter(map(len, self.raw), np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.kept: dict[str, bytes] = {}
        self.prepare()

    def prepare(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        # Pieces that merging reaches, with the two that the last merge joins; lengths by the last two characters.
        self.halves: dict[str, tuple[str, str]] = {}
        lengths: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1 and len(steps := self.merges(p)[1]) and steps[-1][0] + steps[-1][1] == p:
                self.halves[p] = steps[-1]
                lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        # Pieces that merge no later than one of their halves; near them the order of merges isn't that of the ranks.
        self.early = {p for p, h in self.halves.items() if any(len(x) > 1 and self.rank[x] >= self.rank[p] for x in h)}
        self.spines: tuple[dict[str, list], dict[str, list]] = ({}, {})

    def merges(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """The pieces of a short text, by merging the best adjacent pair, leftmost first, while there is one; and the merges."""
        parts, steps = list(text), []
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == np.inf:
                break
            i = best[1]
            steps.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, steps

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at the left (0) or right (1) end of the piece while it is built, and the rank at which that is merged."""
        found = self.spines[side].get(piece)
        if found is None:
            found, x, until = [], piece, np.inf
            while True:
                found.append((x, until))
                if x not in self.halves:
                    break
                x, until = self.halves[x][side], self.rank[x]
            self.spines[side][piece] = found
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b side by side: no merge across the cut comes before theirs (at one rank, the left one does)."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            left, right, rank, early = self.spine(a, 1), self.spine(b, 0), self.rank, self.early
            if early and any(x in early for x, _ in left + right):
                found = self.merges(a + b)[0] == [a, b]
            else:
                found = not any((r := rank.get(x + y)) is not None and r < x_until and r <= y_until for x, x_until in left for y, y_until in right)
            self.pairs[a, b] = found
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers; words are distinct."""
        out: dict[str, bytes] = {}
        none: tuple[int, ...] = ()
        halves, lengths, compatible = self.halves, self.lengths, self.compatible
        before, last = "", [""]  # last[i]: the piece that ends the segmentation of the first i characters
        for word in sorted(words):
            size, shared = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, size + 1):
                piece = word[end - 1]
                for n in lengths.get(word[end - 2 : end], none) if end > 1 else none:
                    if n <= end and (candidate := word[end - n : end]) in halves and (n == end or compatible(last[end - n], candidate)):
                        piece = candidate
                        break
                last.append(piece)
            before, out[word] = word, self.ids_of(last, size)
        return out

    def ids_of(self, last: list[str], end: int) -> bytes:
        """The ids of the first end characters, from the pieces that end the prefixes; what is no piece is spelled in bytes."""
        parts, ids = [], []
        while end:
            parts.append(last[end])
            end -= len(last[end])
        for p in reversed(parts):
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte[x] for x in p.encode()]
        return array("I", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, at = self.encode_batch(pa.array([x or "" for x in texts], pa.string()))
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode_batch(self, text: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts (none null), and where each text's begin among them (with the end at last). Each distinct word is looked up once."""
        spaced = pc.replace_substring(text, MARK, " ")
        data, rows = utf8(pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(" ", spaced, "")))
        edges = word_cuts(data, rows, self.meets)
        parts = parts_of(data, edges)
        words = pc.replace_substring(parts.dictionary, " ", MARK).to_numpy(zero_copy_only=False).tolist()
        raw = list(map(self.kept.get, words))
        missing = [i for i, x in enumerate(raw) if x is None]
        new = self.encode_words([words[i] for i in missing])
        for i in missing:
            raw[i] = new[words[i]]
        ids, ends = joined_runs(raw, parts.indices.to_numpy())
        if len(self.kept) < CACHE_WORDS:
            self.kept |= new
        return ids, ends[np.searchsorted(edges, rows)].tolist()

    def decode_batch(self, ids: np.ndarray, at: list[int]) -> list[str]:
        """The texts of ids, which begin where at says."""
        places, ends = runs(self.raw_start[ids], self.raw_length[ids])
        raw, ends = self.raw_bytes[places].tobytes(), ends[at].tolist()
        return [raw[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_batch(ids, [0, len(ids)])[0]


class Viterbi(Codec):
    """The same for a unigram model: the segmentation of the largest sum of scores, the longer last piece where sums are equal.

    The library adds in single precision, so of equal sums, those of the same pieces in another order, it may take another.
    """

    def prepare(self) -> None:
        self.score = {p: -r for p, r in self.rank.items()}
        #: The library's penalty of a character that is no piece.
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        lengths: dict[str, set[int]] = {}
        for p in self.score:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        none: tuple[int, ...] = ()
        score, lengths, unknown = self.score, self.lengths, self.unknown
        before, last, best = "", [""], [0.0]  # for each prefix of the word, the piece that ends its best segmentation, and its sum
        for word in sorted(words):
            size, shared = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, size + 1):
                piece, top = word[end - 1], -np.inf
                for n in lengths.get(piece, none):
                    if n <= end and (value := score.get(word[end - n : end])) is not None and best[end - n] + value > top:
                        piece, top = word[end - n : end], best[end - n] + value
                if word[end - 1] not in score and best[end - 1] + unknown > top:
                    piece, top = word[end - 1], best[end - 1] + unknown
                last.append(piece)
                best.append(top)
            before, out[word] = word, self.ids_of(last, size)
        return out


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of the model's kind, one for each process; ValueError for another kind, or a model that normalizes texts."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    kinds, rules = {1: Viterbi, 2: Codec}, model.normalizer_spec
    if model.trainer_spec.model_type not in kinds or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces:
        raise ValueError("the model is neither unigram nor BPE, or it normalizes texts")
    return kinds[model.trainer_spec.model_type](path)


def _task(path: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in slices(batch, limit=1 << 22):
                text = part.column("text")
                ids, at = coder.encode_batch(text)
                back = coder.decode_batch(ids, at)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                cols = [
                    part.column("doc_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                    pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                    pa.array([a == b.replace(MARK, " ") for a, b in zip(back, text.to_numpy(zero_copy_only=False), strict=True)], pa.bool_()),
                ]
                more = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.astype(np.int32)), pa.array(back, pa.string())] * with_ids
                names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip", *["ids", "decoded"] * with_ids]
                yield pa.RecordBatch.from_arrays([*cols, *more], names=names)

    return task


def sentencepiece(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32, round_trip; on demand ids and decoded.

    decoded is made from the ids; round_trip: it equals the text (a mark in a text reads as a space). Null or
    empty text: no tokens. Null doc_id and repeated rows are encoded like any other. A text of any length is
    encoded whole; of segmentations that tie, one (see Viterbi). Other columns, whatever their names, are not read. An empty
    table gives an empty result.
    """
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        freed(_task(model, with_ids)), f"doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean{more}"
    )
