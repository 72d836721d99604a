"""Fixtures of the corpus operators: documents with every awkward case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["re", "th", "on", "le", "é", "ou", "st", "Ba"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def doc_rows() -> list[tuple]:
    base, other, shared = words(1, 300), words(2, 220), words(3, 70)
    edited = list(base)
    edited[40] = edited[150] = "EDIT"
    texts = {
        10: " ".join(base),
        3: "\n".join(" ".join(other[i : i + 11]) for i in range(0, 220, 11)),
        11: " ".join(edited),
        12: " ".join(base),
        13: " ".join(other[:60] + shared + other[60:]),
        14: " ".join(words(4, 30) + shared + words(5, 30)),
        15: "\tlead  " + "  \n".join(shared) + "\x0b tail x ",
        16: "",
        17: None,
        18: " \n\t ",
        19: " ".join(["same"] * 400),
        20: " ".join(["same"] * 130),
        21: "x",
        22: " ".join(words(6, 20_000)),
        23: "under the MIT license, CC-BY-NC. Under the  Mit License",
        24: "\n".join([" ".join(other[:11])] * 3 + ["# * $ end |"] * 2),
        25: "don't <|endoftext|> ÀÉ İstanbul 3.14 é  　 x​y foo.bar's 'll \x1c\x1d z",
    }
    rows = [(k, v, "en", "src0", None if v is None else len(v)) for k, v in texts.items()]
    return [*rows, rows[0], (None, " ".join(base), None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(doc_rows, SCHEMA).repartition(3, "n_chars")
    # extra columns whose names the operators use themselves
    return df.withColumns({k: F.lit(7) for k in ("start", "n", "m", "path", "n_words", "kept", "length", "score", "pos", "label")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
