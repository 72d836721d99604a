"""The detail of listings: the first of four sources that has the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.coerce import detail_url, falsy_or, list_or_empty, plain_description
from catalith.operators.lookup import dedup_first, keep_one


def details(api: DataFrame, file: DataFrame, api_docs: DataFrame, file_docs: DataFrame, base_url: str) -> DataFrame:
    """A row for each list_id known anywhere.

    Generated API documents come first, then generated FILE documents, then API and FILE listings. A generated
    document takes its description from the listing of its kind, if there is one.
    """
    one_api, one_file = (dedup_first(x.where("list_id is not null"), ["list_id"], ["list_title", "org_nm"]) for x in (api, file))

    def branch(kind: str, order: int, docs: DataFrame | None, listing: DataFrame) -> DataFrame:
        rows = listing
        if docs is not None:
            first = dedup_first(docs, ["list_id"], ["token_count", "generated_at"])
            rows = first.select("list_id", F.col("token_count").alias("_tokens"), "generated_at", "markdown").join(listing, "list_id", "left")
        has = lambda k: F.col(k) if k in listing.columns else F.lit(None)
        text = lambda k: has(k).cast("string").alias(k)
        title = F.col("list_title") if kind == "API" else falsy_or(F.col("list_title"), has("title"))
        generated = docs is not None
        return rows.select(
            "list_id",
            F.lit(kind).alias("data_type"),
            title.alias("list_title"),
            detail_url(base_url, F.col("list_id"), F.lit(kind)).alias("detail_url"),
            F.lit(generated).alias("generated_status"),
            has("created_at").cast("timestamp").alias("created_at"),
            has("updated_at").cast("timestamp").alias("updated_at"),
            plain_description(has("desc").cast("string")).alias("description"),
            *(text(k) for k in ("org_nm", "dept_nm", "is_charged", "share_scope_nm")),
            list_or_empty(has("keywords").cast("array<string>")).alias("keywords"),
            (F.coalesce("_tokens", F.lit(0)) if generated else F.lit(0)).cast("long").alias("token_count"),
            (F.col("generated_at") if generated else F.lit(None)).cast("timestamp").alias("generated_at"),
            (F.col("markdown") if generated else F.lit(None)).cast("string").alias("markdown"),
            F.lit(order).alias("_order"),
        )

    parts = [branch("API", 0, api_docs, one_api), branch("FILE", 1, file_docs, one_file), branch("API", 2, None, one_api), branch("FILE", 3, None, one_file)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return keep_one(rows, ["list_id"], [F.col("_order").asc()]).drop("_order")


def detail(all_details: DataFrame, list_id: int) -> DataFrame:
    """The detail of one id; the filter goes down to every source."""
    return all_details.where(F.col("list_id") == list_id)


def enriched(recommended: DataFrame, api: DataFrame, file: DataFrame) -> DataFrame:
    """Recommendations with the title of the listing they name, API before FILE; those without a listing go.

    recommended: target_doc_id, doc_id (text), similarity_score, rank. doc_ids that aren't numbers go as well.
    """
    known = (
        api.select("list_id", "list_title", "org_nm", F.lit("API").alias("data_type"), F.lit(0).alias("_source"))
        .unionByName(file.select("list_id", falsy_or(F.col("list_title"), F.col("title")).alias("list_title"), "org_nm", F.lit("FILE").alias("data_type"), F.lit(1).alias("_source")))
        .where("list_id is not null")
    )
    known = dedup_first(known, ["list_id"], ["_source", "list_title", "org_nm"]).drop("_source")
    asked = recommended.withColumn("list_id", F.col("doc_id").try_cast("long")).where("list_id is not null")
    return asked.join(known, "list_id").select("target_doc_id", "rank", "list_id", "list_title", "org_nm", "data_type", "similarity_score")
