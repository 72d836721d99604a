"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalith.llm import ann_search, license_scan, line_dedup, merkle_manifest, minhash_dedup, packing, quality_rules
from catalith.llm import secret_scan, sentencepiece_codec, substring_dedup, token_alignment, token_files, toxicity
from catalith.llm.common import table
from catalith.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_search.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2, min_words=50))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, spaced=False, end_id=1, longest=2048)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), path, spaced=True, end_id=0)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.sentencepiece(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"), *paths)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents"), owner="source", repository="doc_id"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.digest_of_proofs(table(spark, sf_dir, "documents"))


_ALL = (
    op1_substring_dedup,
    op2_license_scan,
    op3_toxicity,
    op4_ann_search,
    op5_line_dedup,
    op6_packing,
    op7_token_files,
    op8_minhash_dedup,
    op9_sentencepiece,
    op10_quality_rules,
    op11_token_alignment,
    op12_secret_scan,
    op13_merkle_manifest,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
