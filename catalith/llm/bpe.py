"""Token ids of whole texts through a public tokenizer file, encoding each distinct piece once.

The library encodes a text of invented or rare words at 1-2 MB/s. Its pre-tokenizers cut every text at
white space and between letters and punctuation, and never merge across those cuts, so the ids of
a text are the ids of its pieces in order. A piece found before is read from a dictionary of the task's
process, which stops growing at CACHE_PIECES (the pieces after that are encoded for a batch, not kept). New pieces are encoded
JOINED at a time in one string, as the library spends more on a string than on a short piece; a word of a byte-level
tokenizer is one of its pre-tokens, so the library's model is asked for it directly. For whole batches of a byte-level tokenizer the
cuts are found on bytes (spaced_cuts) and each distinct piece of a batch is looked up once.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import pyarrow as pa

from catalith.llm.common import joined_runs, parts_of, utf8

#: Pieces that a process keeps, about 250 bytes each; pieces of one string.
CACHE_PIECES, JOINED = 450_000, 2_000

_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_MARK = ".,;:!?|#*$%&"
#: Letters before white space, a mark or the end; marks before white space or the end; else up to white space.
_WORDS = re.compile(rf"[a-zß-öø-ÿ]+(?=[{_SPACE}{_MARK}]|\Z)|[{_MARK}]+(?=[{_SPACE}]|\Z)|[^{_SPACE}]+")
_ONE_WORD = re.compile(rf"[a-zß-öø-ÿ]+|[{_MARK}]+")
#: The same with the white space before a piece, which byte-level tokenizers keep.
_SPACED = re.compile(rf"[{_SPACE}]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{_SPACE}{_MARK}]|\Z)|[{_MARK}]+(?=[{_SPACE}]|\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: One pre-token of a byte-level tokenizer, and the characters that its model has for bytes.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

#: Classes of bytes. The others are ASCII that is never white space; bytes of class 0 are not known by themselves.
_LETTER, _DIGIT, _SIGN, _BLANK, _OTHER = range(1, 6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
for _kind, _chars in ((_LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (_DIGIT, b"0123456789"), (_SIGN, _MARK.encode()), (_BLANK, b"\t\n\x0b\x0c\r ")):
    _CLASS[list(_chars)] = _kind
#: Last bytes, the lowest first, of white space outside ASCII by the bytes before them.
_WIDE_BLANKS = [(b"\xc2", b"\x85\xa0"), (b"\xe1\x9a", b"\x80"), (b"\xe2\x80", bytes([*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF])), (b"\xe2\x81", b"\x9f"), (b"\xe3\x80", b"\x80")]


def spaced_cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places in the bytes of texts where a byte-level pre-tokenizer cuts whatever follows, with the rows' beginnings and the end.

    Letters, digits and marks end where another class begins, and all of them where white space begins. Of white space before
    another character the last one stands alone or, if it is a space, with what follows. Where a neighbour may be of
    another class than its byte tells, there is no cut.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    if n:
        kind = _CLASS[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        left, right = kind[:-1], kind[1:]
        known = (left > 0) & ((right == _BLANK) | ((left < _BLANK) & (right > 0) & (right < _BLANK)))
        edge[1:n] = known & (left != right)
        wide = np.flatnonzero((data[:-1] >= 0x80) & (left == 0) & (right == _BLANK))
        for before, last in _WIDE_BLANKS:
            blank = np.isin(data[wide], np.frombuffer(last, np.uint8)) & (wide >= len(before))
            for i, b in enumerate(reversed(before), 1):
                blank &= data[np.maximum(wide - i, 0)] == b
            wide = wide[~blank]
        edge[wide + 1] = True
        edge[rows] = True
        final = np.flatnonzero((left == _BLANK) & (right > 0) & (right != _BLANK))
        final = final[~edge[final + 1]]  # in one row with what follows
        edge[final[(final > 0) & (kind[final - 1] == _BLANK)]] = True
        edge[final[edge[final] & (data[final] != 0x20)] + 1] = True
    edge[[0, n]] = True
    return np.flatnonzero(edge)


class PieceEncoder:
    """spaced: the tokenizer is byte-level; else it drops white space and lower-cases.

    plain: strings of special tokens in a text are ordinary text; else they are those tokens, as in the library's own call.
    most: pieces that are kept, CACHE_PIECES by default.
    """

    def __init__(self, path: str, spaced: bool, plain: bool = False, most: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special and not plain else None
        self.spaced = spaced
        before = self.tokenizer.pre_tokenizer
        #: Whether words go to the model directly.
        self.direct = spaced and self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        self.kept: dict[str, bytes] = {}
        self.most = most
        #: What stands between pieces, and which ids end one: the line feed's own, or those that close a word.
        self.between = "\n" if spaced else " "
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[self.tokenizer.encode("\n", add_special_tokens=False).ids if spaced else [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def simple(self, piece: str) -> bool:
        """Whether the piece can stand in one string with others: it has no line feed, or is one word."""
        return "\n" not in piece if self.spaced else _ONE_WORD.fullmatch(piece) is not None

    def fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces."""
        alone, joined, out = [], [], {}
        model = self.tokenizer.model
        for p in pieces:
            if self.direct and _WORD.fullmatch(p):
                chars = p.replace(" ", "Ġ") if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_CHARS)
                out[p] = array("I", [t.id for t in model.tokenize(chars)]).tobytes()
            else:
                (joined if self.simple(p) else alone).append(p)
        for i in range(0, len(joined), JOINED):
            part = joined[i : i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids])
            ends = [*(4 * at).tolist(), 4 * len(ids)] if self.spaced else (4 * (at + 1)).tolist()
            starts = [0, *(4 * (at + 1)).tolist()][: len(ends)]
            if len(ends) == len(part):
                raw = ids.tobytes()
                out.update(zip(part, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
            else:
                alone += part
        found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False) if alone else []
        return out | {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(alone, found, strict=True)}

    def pieces(self, text: str) -> list[str]:
        return _SPACED.findall(text) if self.spaced else _WORDS.findall(text.encode().lower().decode())  # A-Z only

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = [x or "" for x in texts]
        whole = [self.special is not None and self.special.search(x) is not None for x in texts]  # special tokens are found before a text is cut
        out = self.encode_pieces([[] if w else self.pieces(x) for w, x in zip(whole, texts, strict=True)])
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def encode_pieces(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of texts cut into pieces."""
        kept = self.kept
        fresh = self.fresh(list(set(chain.from_iterable(cut)).difference(kept)))
        kept.update(fresh)
        out = [b"".join(map(kept.__getitem__, p)) for p in cut]
        most = CACHE_PIECES if self.most is None else self.most
        if len(kept) > most:
            for p in list(fresh)[max(0, most - len(kept) + len(fresh)) :]:
                del kept[p]
        return out

    def encode_batch(self, text: pa.Array) -> list[np.ndarray]:
        """The ids of each text (none null) of a byte-level tokenizer's batch."""
        data, rows = utf8(text)
        edges = spaced_cuts(data, rows)
        parts = parts_of(data, edges)
        pieces = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        raw = list(map(self.kept.get, pieces))
        missing = [i for i, x in enumerate(raw) if x is None]
        fresh = self.fresh([pieces[i] for i in missing])
        for i in missing:
            raw[i] = fresh[pieces[i]]
        ids, ends = joined_runs(raw, parts.indices.to_numpy())
        most = CACHE_PIECES if self.most is None else self.most
        self.kept.update(islice(fresh.items(), max(0, most - len(self.kept))))
        at = ends[np.searchsorted(edges, rows)].tolist()
        out = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i, x in enumerate(text.to_numpy(zero_copy_only=False) if self.special else []):
            if self.special.search(x):
                out[i] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4")
        return out


@functools.lru_cache(4)
def encoder(path: str, spaced: bool, plain: bool = False, most: int | None = None) -> PieceEncoder:
    """One for each process, which Spark uses for many tasks."""
    return PieceEncoder(path, spaced, plain, most)
