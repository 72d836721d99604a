import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from catalith.llm import bpe, packing, token_files
from catalith.llm.queries import op6_packing, op7_token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, texts, end, plain=False):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def brute_pieces(rows, path, end, longest):
    out = []
    for (i, _), ids in zip(rows, ids_of(path, [t for _, t in rows], end), strict=True):
        at = 0
        for n in packing.lengths(len(ids), longest):
            out.append((i, at, n, crc(ids[at : at + n]), len(ids)))
            at += n
    return out


def check_pieces(got, rows, longest=2048):
    assert Counter(tuple(r)[:5] for r in got) == Counter(brute_pieces(rows, WORD, 1, longest))
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert all(r["offset"] == 0 and r["length"] <= longest and not r["length"] & (r["length"] - 1) for r in got)
    in_order = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert in_order == sorted(in_order, reverse=True)


def test_lengths():
    for n in range(1, 300):
        assert sum(packing.lengths(n, 64)) == n


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_pieces_encode_as_the_library(doc_rows, path, spaced, plain):
    special = ["<|endoftext|>", "a <|endoftext|>\n<|startoftext|> b", " <|ENDOFTEXT|>x", "foo  <|endoftext|>  bar\n <|startoftext|>\n", "x<|endoftext|", "y<|startoftext|><|endoftext|>"]
    texts = [r[1] for r in doc_rows] + special + ["a.b'll ,x", "Σς ΣΑΣ.́ x́. á", "\x85\x85a \r\n\tb\x0c ", "!!..  ..!! ?", "12ab3c.4d", " x  y", "The'S x'", " ́ a"]
    coder = bpe.PieceEncoder(path, spaced, plain)
    got = [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)]
    assert got == [x[:-1] for x in ids_of(path, texts, 0, plain)]


def test_full_cache(monkeypatch, doc_rows):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    coder = bpe.PieceEncoder(BYTE, True)
    texts = [r[1] for r in doc_rows]
    want = [x[:-1] for x in ids_of(BYTE, texts, 0)]
    for _ in range(2):
        assert [np.frombuffer(coder.encode([t])[0], "<u4").tolist() for t in texts] == want


def test_batches_encode_as_the_library(monkeypatch, doc_rows):
    r = random.Random(3)
    chars = [*"aabstvel'''  \n\n\t\r\x0b\x0c\x1c\x00.,!#|12)(-_\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000éß×÷Àÿ日か😀\u0301²½ª—", "'s", "'ll", "<|endoftext|>", "  ", " \n", "\n\n", "the ", " of", "'\u200a  "]
    texts = [x[1] or "" for x in doc_rows] + ["".join(r.choices(chars, k=r.randint(0, 30))) for _ in range(5000)]
    want = [x[:-1] for x in ids_of(BYTE, texts, 0)]
    for most in (None, 3):
        coder = bpe.PieceEncoder(BYTE, True, most=most)
        got = [x.tolist() for i in range(0, len(texts), 700) for x in coder.encode_batch(pa.array(texts[i : i + 700], pa.string()))]
        assert got == want
        assert most is None or len(coder.kept) == most
    assert coder.encode_batch(pa.array([], pa.string())) == []


def test_a_piece_of_a_batch_is_found_once():
    coder, asked = bpe.PieceEncoder(BYTE, True), []
    real = coder.fresh
    coder.fresh = lambda pieces: asked.extend(pieces) or real(pieces)
    coder.encode_batch(pa.array(["word. word, word word; word\nword 12word"]))
    coder.encode_batch(pa.array(["a word\n\nword word."]))
    assert len(asked) == len(set(asked)) and sorted(p for p in asked if "word" in p) == [" word", "word"]


def test_pack(docs, doc_rows):
    check_pieces(packing.pack(docs, WORD, False, 1).collect(), [r[:2] for r in doc_rows])
    got = packing.pack(docs, WORD, False, 1, longest=16, with_ids=True).collect()
    check_pieces(got, [r[:2] for r in doc_rows], 16)
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in got)


def test_empty(no_docs):
    assert packing.pack(no_docs, WORD, False, 1).collect() == []
    assert token_files.token_file_digest(no_docs, BYTE, True, 0).collect() == []


def check_files(got, rows):
    ids = ids_of(BYTE, [t for _, t in rows], 0)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for (i, _), x in zip(rows, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys)


def test_token_files(docs, doc_rows):
    check_files(token_files.token_file_digest(docs, BYTE, True, 0).collect(), [r[:2] for r in doc_rows])


def test_damage_is_seen():
    import io

    good = token_files.frame(b"payload")
    assert token_files.unframe(io.BytesIO(good).read) == b"payload"
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            token_files.unframe(io.BytesIO(bytes(bad)).read)


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(op6_packing(spark, sf).collect(), rows)
    check_files(op7_token_files(spark, sf).collect(), rows)
