import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from catalith.llm import merkle_manifest as op
from tests.llm.conftest import SCHEMA


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """All levels, and for a leaf the runs on its way up."""
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def way(rows, i):
    out = []
    for row in rows[:-1]:
        run = i // 3 * 3
        out.append((row[run:i], row[i + 1 : run + 3]))
        i //= 3
    return out


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, tree([leaf(r) for r in own])))
    top = tree([t[-1][0] for _, t in trees]) if trees else []
    out = []
    for k, (own, t) in enumerate(trees):
        for i, r in enumerate(own):
            path = way(t, i) + way(top, k)
            found = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                found[4] = r[4].replace("\n", "")
            node = leaf(found)
            for before, after in path:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r), t[-1][0], top[-1][0], h(*(x for p in path for side in p for x in side)), node, node == top[-1][0]))
    return Counter(out)


def reorder(r):
    return (r[0], r[3], r[2], r[4], r[1])


def test_all_cases(docs, doc_rows):
    got = op.digest_of_proofs(docs)
    assert Counter(map(tuple, got.collect())) == brute([reorder(r) for r in doc_rows])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80, 81, 82, 243, 300])
def test_traversal(n):
    leaves = [h(str(i)) for i in range(n)]
    paths, root = op.walk(leaves, op.levels(n))
    rows = tree(leaves)
    assert root == rows[-1][0]
    assert paths == [tuple(("".join(a), "".join(b)) for a, b in way(rows, i)) for i in range(n)]


def test_stack_is_logarithmic():
    stack = op.Treehash(6)
    most = 0
    for i in range(3**6 + 500):
        stack.update(h(str(i)))
        most = max(most, len(stack.stack))
    assert most <= 2 * 6 + 3


def test_short_blocks_keep_their_height():
    """The last block of a larger tree may hold a single node, which is folded up to the block's height."""
    paths, root = op.walk([h("x")], 3)
    assert paths == [(("", ""),) * 3] and root == h(h(h(h("x"))))


@pytest.mark.parametrize("levels", [1, 2])
def test_many_layers(spark, monkeypatch, levels):
    """Small blocks: several layers of blocks, sources that run over many ranges, sources of one row, null sources and ties."""
    monkeypatch.setattr(op, "LEVELS", levels)
    monkeypatch.setattr(op, "_block", _block_of(levels))
    r = random.Random(levels)
    rows = [(i, f"line\n{i % 7}", "en", "hot" if i % 3 else r.choice([None, "", "é", "z", "Z", *map(str, range(40))]), i) for i in range(400)]
    rows += [(7, "tie", None, "hot", None)] * 3 + [(7, "tie2", None, "hot", None), (None, "a\nb", "x", "hot", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = op.digest_of_proofs(docs).collect()
    assert Counter(map(tuple, got)) == brute([reorder(x) for x in rows])


def _block_of(levels):
    real = op._block

    def made(columns):
        task = real(columns)

        def run(nodes):
            op.LEVELS, kept = levels, op.LEVELS
            try:
                return task(nodes)
            finally:
                op.LEVELS = kept

        return run

    return made


def test_one_source_and_one_row(spark):
    for rows in ([(1, "a\nb", "en", "s", 3)], [(i, "a\nb", "en", "s", 3) for i in range(5)], [(1, "x", None, "a", 1), (1, "x", None, "b", 1)]):
        got = op.digest_of_proofs(spark.createDataFrame(rows, SCHEMA))
        assert Counter(map(tuple, got.collect())) == brute([reorder(r) for r in rows])


def test_null_and_empty_differ(spark):
    rows = [(1, "", "", "s", 0), (1, None, None, "s", None)]
    assert len({r["leaf"] for r in op.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()}) == 2


def test_empty(no_docs):
    assert op.digest_of_proofs(no_docs).collect() == []
