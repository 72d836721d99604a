"""The queries against their SQL: awkward cases of the fixture with unique ids, and the small tables where they lie."""

import os
from collections import Counter

import duckdb
import pytest

from catalith.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"


def compare(spark, name, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet{'' if os.path.isfile(f'{sf_dir}/documents.parquet') else '/*.parquet'}'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(columns).collect()]
    assert Counter(rows) == Counter(want.fetchall())
    return rows


@pytest.fixture(scope="module")
def awkward(spark, doc_rows, tmp_path_factory):
    from tests.llm.conftest import SCHEMA

    folder = str(tmp_path_factory.mktemp("awkward"))
    more = [
        (40, "a b c\nd e f\n\n g h \nd e f\n\n g h ", "en", "s", 1),
        (41, "a b c\nd e f\n g h \n", "en", "s", 1),
        (42, "this work is licensed under the NEW gnu general public license version 3 cc by nc cc by nc", "en", "s", 1),
        (43, "one two", "en", "s", 1),
        (44, "ONE\x0btwo", "en", "s", 1),
    ]
    unique = {r[0]: r for r in doc_rows if r[0] is not None}
    spark.createDataFrame([*unique.values(), *more], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_awkward(spark, awkward, name):
    assert compare(spark, name, awkward)


@pytest.mark.skipif(not os.path.exists(SMALL), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_small_tables(spark, name):
    assert compare(spark, name, SMALL)
