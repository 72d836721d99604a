"""The corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import line_dedup, minhash_dedup, packing, substring_dedup, toxicity
from catalith.llm.common import cut, free_name, table

#: Pieces that a process keeps while it packs: few, as the stages before need the memory of the machine when a run follows another.
KEPT_PIECES = 50_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at toxicity.THRESHOLD or more go. The score depends on the text alone, so equal rows fare alike.

    Null and empty texts score as texts without toxic words. An empty table stays empty.
    """
    scored = toxicity.mark_toxic(docs, table(spark, sf_dir, "labels"))
    return scored.where(~F.col(scored.columns[-1])).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of two lines, or of a line of 50 words, go; every document stays, at least with an empty text.

    Null texts and rows with a null doc_id stay as they are. An empty table stays empty.
    """
    return line_dedup.line_dedup(docs, min_lines=2, min_words=50).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id. Rows with one doc_id are one document.

    Null, empty and blank texts are in no group and stay, as do rows with a null doc_id. An empty table stays empty.
    """
    name = free_name(docs, "_gone")
    gone = minhash_dedup.near_duplicates(docs, words=5, percent=80).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a window of 50 that a document of smaller doc_id has go; every document stays.

    Null texts and rows with a null doc_id stay as they are. An empty table stays empty.
    """
    return substring_dedup.substring_dedup(docs, window=50).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence, as op6 packs. A null or empty text is the end id alone. An empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1, longest=2048, kept_pieces=KEPT_PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_substrings),
    ("packing", pack),
]
#: Packing needs a tokenizer, which SQL has not.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents. What a stage keeps is written once, and the next one reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
