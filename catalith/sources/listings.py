"""Schemas of the catalog's tables (the columns that operators read), and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.coerce import falsy_or

API_LISTING = (
    "list_id bigint, list_title string, title string, title_en string, desc string, org_nm string, dept_nm string, category_nm string, new_category_nm string, "
    "data_format string, api_type string, is_charged string, is_copyrighted string, is_third_party_copyrighted string, register_status string, share_scope_nm string, "
    "use_prmisn_ennc string, keywords array<string>, request_cnt bigint, created_at timestamp, updated_at timestamp"
)
FILE_LISTING = (
    "list_id bigint, list_title string, title string, desc string, org_nm string, dept_nm string, new_category_nm string, data_type string, "
    "is_charged string, is_copyrighted string, is_third_party_copyrighted string, register_status string, share_scope_nm string, ownership_grounds string, "
    "keywords array<string>, download_cnt bigint, created_at timestamp, updated_at timestamp"
)
GENERATED = "list_id bigint, detail_url string, markdown string, llm_model string, token_count bigint, result_json string, detail string, generated_at timestamp"
SAVED_REQUEST = "list_id bigint, url string, created_at timestamp"
VECTOR = "doc_id string, doc_type string, content string, vector array<float>"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with a declared schema: nothing is inferred, and only the columns used are read."""
    return spark.read.schema(schema).parquet(path)


def recommendation_corpus(api: DataFrame, file: DataFrame, api_first: bool = False) -> DataFrame:
    """doc_id, doc_type and the text columns of both kinds; rows of the kind that comes first have the smaller source.

    A FILE title that is null or empty falls back to title.
    """

    def of(kind: str, listing: DataFrame, source: int) -> DataFrame:
        text = lambda k: (F.col(k) if k in listing.columns else F.lit(None)).cast("string").alias(k)
        keywords = F.col("keywords") if "keywords" in listing.columns else F.array()
        category = "new_category_nm" if "new_category_nm" in listing.columns else "category_nm"
        title = falsy_or(F.col("list_title"), F.col("title")) if kind == "FILE" and "title" in listing.columns else F.col("list_title")
        return listing.where("list_id is not null").select(
            F.col("list_id").cast("string").alias("doc_id"),
            F.lit(kind).alias("doc_type"),
            title.alias("list_title"),
            *(text(k) for k in ("desc", "org_nm")),
            text(category).alias("category_nm"),
            keywords.cast("array<string>").alias("keywords"),
            F.lit(source).alias("source"),
        )

    sides = [of("API", api, 0 if api_first else 1), of("FILE", file, 1 if api_first else 0)]
    return sides[0].unionByName(sides[1])
