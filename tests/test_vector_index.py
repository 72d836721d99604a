"""The inverted-file index: exact rows against all pairs, recall of the approximate form, rings that are ruled out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.operators import vector_index, vectors

SCHEMA = "doc_id string, doc_type string, vector array<float>"


def frame(spark, matrix, more=()):
    rows = [(str(i), "API" if i % 2 else "FILE", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame([*rows, *more], SCHEMA)


def clustered(n, centres, size, seed, spread=0.15):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, size))
    return middle[r.integers(0, centres, n)] + spread * r.normal(size=(n, size))


ODD = [("null", "API", None), ("zero", "API", [0.0] * 8), ("nan", "API", [float("nan")] * 8), (None, "API", [1.0] * 8), ("3", "FILE", [1.0] * 8)]


def found(df):
    return sorted((r["target_doc_id"], r["rank"], r["doc_id"], r["doc_type"], round(r["similarity_score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """400 vectors of 20 clusters and a third as many of one vector, in blocks of 16 rows."""
    m = np.concatenate([clustered(400, 20, 8, 1), np.tile(np.arange(1.0, 9.0), (130, 1))])
    v = frame(spark, m, ODD)
    return v, vector_index.write_vector_index(v, str(tmp_path_factory.mktemp("ivf")), lists=20, block_rows=16)


def test_rows_and_blocks(stored):
    v, index = stored
    rows = index.rows.collect()
    assert len(rows) == 530 and {r["doc_id"] for r in rows} == {str(i) for i in range(530)}
    assert all(np.isclose(np.linalg.norm(np.array(r["v"]) - index.centres[r["list"]]), r["far"]) for r in rows)
    blocks = {r["block"]: r for r in index.blocks.collect()}
    assert max(b["n"] for b in blocks.values()) <= 16 and sum(b["n"] for b in blocks.values()) == 530
    for r in rows:
        b = blocks[r["block"]]
        assert b["list"] == r["list"] and b["near"] <= r["far"] <= b["far"]


@pytest.mark.parametrize(("top_k", "threshold"), [(4, 0.5), (20, 0.0), (1, 0.99)])
def test_exact_rows_are_those_of_all_pairs(stored, top_k, threshold):
    v, index = stored
    some = vectors.usable(v).where("try_cast(doc_id as int) < 400")  # of the equal vectors, the order is that of rounding
    got = [r for r in found(vector_index.exact_neighbours(index, some, top_k, threshold)) if int(r[2]) < 400]
    want = [r for r in found(vectors.all_neighbours(v, top_k, threshold, targets=some)) if int(r[2]) < 400]
    assert got == want and len(got) > 100


def test_rings_are_ruled_out(stored):
    v, index = stored
    row = vector_index.compared(index, vectors.usable(v), 0.9).first()
    assert row["all_pairs"] == 530 * 530 and row["pairs"] < row["all_pairs"] / 4


def test_recall_of_probes(stored):
    v, index = stored
    asked = vectors.usable(v).where("try_cast(doc_id as int) % 5 = 0 and try_cast(doc_id as int) < 400")
    exact = {(r[0], r[2]) for r in found(vector_index.exact_neighbours(index, asked, 5, 0.0))}
    got = found(vector_index.search(index, asked, 5, 0.0, probes=4))
    assert len({(r[0], r[2]) for r in got} & exact) >= 0.9 * len(exact)
    every = found(vector_index.search(index, asked, 5, 0.0, probes=99))
    assert len({(r[0], r[2]) for r in every} & exact) >= 0.99 * len(exact)
    assert all(r[0] != r[2] for r in got) and max(r[1] for r in got) == 5


def test_stored_index_is_read_again(spark, stored, tmp_path):
    v, index = stored
    asked = vectors.usable(v).where("doc_id in ('7', '8')")
    folder = str(tmp_path)
    vector_index.write_vector_index(v, folder, lists=5)
    assert found(vector_index.exact_neighbours(vector_index.read_vector_index(spark, folder), asked)) == found(vector_index.exact_neighbours(index, asked))


def test_one_list_and_no_rows(spark, tmp_path):
    one = vector_index.write_vector_index(frame(spark, [[1.0, 0.0], [1.0, 0.1]]), str(tmp_path / "one"), lists=1)
    asked = vectors.usable(frame(spark, [[1.0, 0.0]]))
    assert [r[2] for r in found(vector_index.search(one, asked))] == ["1"] == [r[2] for r in found(vector_index.exact_neighbours(one, asked))]
    none = vector_index.write_vector_index(frame(spark, []), str(tmp_path / "none"))
    assert found(vector_index.search(none, asked)) == found(vector_index.exact_neighbours(none, asked)) == []
    assert vector_index.search(one, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_index.search(one, asked, top_k=0)


def test_sample_is_bounded(spark):
    v = vectors.usable(frame(spark, clustered(300, 3, 8, 4)))
    assert len(vector_index.fit_centres(v, 3, sample_rows=50)) == 3
    assert vector_index.default_lists(10**6) == 1000 and vector_index.default_lists(10**12) == vector_index.MAX_LISTS


def test_hashes_of_ids_choose_the_sample(spark):
    v = vectors.usable(frame(spark, clustered(200, 4, 8, 2)))
    a, b = vector_index.fit_centres(v, 4), vector_index.fit_centres(v.repartition(7, F.col("doc_type")), 4)
    assert np.allclose(np.sort(a, axis=0), np.sort(b, axis=0))
