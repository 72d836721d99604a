import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalith.llm import token_alignment as op
from catalith.llm.queries import op11_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> a <unk> </s> <0x41>", "▁mark ▁▁ two", "a\x00b\x1f\n\n\n  c", "日本語のテキスト 한국어 문장 🙂🙃", "=" * 5000, "0123456789" * 40, "ab" * 3000, " lead  and trail  ", "\n", "́e ́", "x" * 3001]


def brute(texts):
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    at = op.byte_level()
    char = {v: k for k, v in at.items()}
    assert len(char) == 256 and char[0x20] == "Ġ" and char[0x0A] == "Ċ"  # fixed values of byte-level vocabularies
    rows, links = [], []
    for text in texts:
        rows.append([0, 0, 0, 0, ""])
        links.append(Counter())
        if not text:
            continue
        a, b = tokenizer.encode(" " + text, add_special_tokens=False), model.encode(text)
        raw_a = [bytes(at[c] for c in t) for t in a.tokens]
        raw_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            continue
        ends_a, ends_b = ([sum(map(len, raw[: i + 1])) for i in range(len(raw))] if len(raw) < 400 else np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            g = ([], [])
            while i < len(ends_a) and ends_a[i] <= cut:
                g[0].append(a.ids[i])
                i += 1
            while j < len(ends_b) and ends_b[j] <= cut:
                g[1].append(b[j])
                j += 1
            groups.append(g)
        for x, y in groups:
            many_x, many_y = Counter(x), Counter(y)
            links[-1].update({(p, q): m * n for p, m in many_x.items() for q, n in many_y.items()})
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows[-1] = [len(a.ids), len(b), len(groups), sum(links[-1].values()), hashlib.sha256(said.encode()).hexdigest()]
    count = Counter(p for x in links for p in x)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    for row, x in zip(rows, links, strict=True):
        row[4:4] = [sum(n for p, n in x.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in x.items())]
    return [tuple(r) for r in rows], count


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(docs, rows, got=None):
    got = got or op.token_alignment(docs, A, B)
    want, count = brute([t for _, t in rows])
    assert Counter(tuple(r) for r in got.select("doc_id", *COLUMNS).collect()) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    return count


def test_all_cases(spark, docs, doc_rows):
    more = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [r[:2] for r in doc_rows] + [(100 + i, t) for i, t in enumerate(ODD)]
    count = check(more, rows)
    table = op.link_table(more, A, B).collect()
    assert {(r["a"], r["b"]): r["n_docs"] for r in table} == dict(count)
    assert all(r["best"] == (r["n_docs"] == max(n for (a, _), n in count.items() if a == r["a"])) for r in table[:500])


def test_small_blocks_and_large_groups(monkeypatch):
    """In one process: passes and listed links of other sizes give the same links; one group of very many."""
    both = op.Aligner(A, B)
    texts = [None, "", *ODD, "plain words here"]
    whole = both.align(texts)
    monkeypatch.setattr(op, "LISTED_LINKS", 0)
    for k, v in both.align(texts).items():
        assert (v == whole[k]) if isinstance(v, list) else v.tolist() == whole[k].tolist()
    parts = [both.align([t]) for t in texts]
    assert [p["groups"][0] for p in parts] == whole["groups"]


def test_groups_of_intervals():
    """Offsets where tokens of both end, for random cuts of the same bytes."""
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 60))
        ends = [np.append(np.flatnonzero(r.random(n - 1) < p) + 1, n) for p in r.random(2)]
        a, b = op.groups_of(np.append(0, ends[0][:-1]), ends[0], np.append(0, ends[1][:-1]), ends[1])
        shared = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert ends[0][a - 1].tolist() == shared == ends[1][b - 1].tolist()


def test_many_blocks(spark, docs, doc_rows, monkeypatch):
    """A document to a block: the counts still cover all of them."""
    monkeypatch.setattr(op, "_task", lambda *x: _small(*x))
    check(docs, [r[:2] for r in doc_rows])


def _small(*x):
    def task(batches):
        op.BLOCK_BYTES = op.PASS_BYTES = 1
        try:
            yield from original(batches)
        finally:
            op.BLOCK_BYTES, op.PASS_BYTES = 4 << 20, 1 << 19

    original = REAL(*x)
    return task


REAL = op._task


def test_groups_as_text(docs):
    found = op.aligned(docs, A, B, with_groups=True).where("pairs is null").collect()
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in found)


def test_empty(no_docs):
    assert op.token_alignment(no_docs, A, B).collect() == []


@pytest.mark.parametrize("n", [200])
def test_query(spark, n):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = op11_token_alignment(spark, sf)
    assert got.columns == ["doc_id", *COLUMNS]
    check(docs, rows, got)
    assert got.where(F.col("n_links") < F.col("n_best")).count() == 0
