"""Stored recommendations: one versioned row for each target, read before neighbours are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.coerce import first_elements, plus_days

ITEM = "struct<doc_id: string, doc_type: string, similarity_score: double, rank: int>"
STORED = f"target_doc_id string, target_doc_type string, recommendations array<{ITEM}>, created_at timestamp, updated_at timestamp, version int, expires_at timestamp"
TTL_DAYS = 7


def gathered(targets: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each target (target_doc_id, target_doc_type) with its neighbours by rank; an empty list without any."""
    lists = found.groupBy("target_doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "doc_type", "similarity_score"))).alias("_found"))
    items = F.transform("_found", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["doc_type"].alias("doc_type"), x["similarity_score"].alias("similarity_score"), x["rank"].alias("rank")))
    none = F.array().cast(f"array<{ITEM}>")
    return targets.join(lists, "target_doc_id", "left").select("target_doc_id", "target_doc_type", F.coalesce(items, none).alias("recommendations"))


def upsert(stored: DataFrame, new: DataFrame, as_of: Column, ttl_days: int | None = TTL_DAYS) -> DataFrame:
    """stored with new: a known target gets the new items, updated_at and the next version; others start at version 1."""
    fresh = new.select("target_doc_id", F.col("target_doc_type").alias("_type"), F.col("recommendations").alias("_items"), F.lit(True).alias("_new"))
    both = stored.join(fresh, "target_doc_id", "full_outer")
    is_new = F.col("_new").isNotNull()
    until = plus_days(as_of, ttl_days) if ttl_days is not None else F.lit(None).cast("timestamp")
    return both.select(
        "target_doc_id",
        F.coalesce("_type", "target_doc_type").alias("target_doc_type"),
        F.when(is_new, F.col("_items")).otherwise(F.col("recommendations")).alias("recommendations"),
        F.coalesce("created_at", as_of).alias("created_at"),
        F.when(is_new, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(is_new, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).cast("int").alias("version"),
        F.when(is_new, until).otherwise(F.col("expires_at")).alias("expires_at"),
    )


def cached(stored: DataFrame, top_k: int, as_of: Column | None = None) -> DataFrame:
    """The first top_k items of every target that has any; with as_of, of those that haven't expired by then."""
    live = stored if as_of is None else stored.where(F.coalesce(F.col("expires_at") > as_of, F.lit(True)))
    rows = live.where(F.size("recommendations") > 0).select("target_doc_id", F.explode(first_elements(F.col("recommendations"), top_k)).alias("r"))
    return rows.select("target_doc_id", "r.doc_id", "r.doc_type", "r.similarity_score", "r.rank")


def misses(targets: DataFrame, stored: DataFrame) -> DataFrame:
    """Targets without stored items; an empty list is a miss as well."""
    return targets.join(stored.where(F.size("recommendations") > 0).select("target_doc_id"), "target_doc_id", "left_anti")


def failed(made: DataFrame) -> DataFrame:
    """failed: how many targets have no neighbours, such as those without a vector."""
    return made.agg(F.count(F.when(F.size("recommendations") == 0, 1)).cast("long").alias("failed"))


def cache_first(targets: DataFrame, stored: DataFrame, computed: DataFrame, top_k: int) -> DataFrame:
    """Items of targets from the store (source cache), else from computed (source realtime)."""
    hit = cached(stored, top_k).join(targets.select("target_doc_id"), "target_doc_id", "left_semi").withColumn("source", F.lit("cache"))
    made = computed.where(F.col("rank") <= top_k).join(misses(targets, stored).select("target_doc_id"), "target_doc_id", "left_semi")
    return hit.unionByName(made.select("target_doc_id", "doc_id", "doc_type", "similarity_score", "rank").withColumn("source", F.lit("realtime")))


def to_store(made: DataFrame) -> DataFrame:
    """Of what was computed, the targets worth storing: those with items."""
    return made.where(F.size("recommendations") > 0)


def remove(stored: DataFrame, target_doc_ids: list[str] | None = None) -> DataFrame:
    """stored without these targets; without all of them if none are named."""
    if target_doc_ids is None:
        return stored.limit(0)
    return stored.where(~F.col("target_doc_id").isin(list(target_doc_ids)))


def cache_stats(stored: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """One row: stored targets, those updated in the last 24 hours, items for each, and the share of requests that hit.

    requests: target_doc_id of each request. The ratio is text, in percent to two places.
    """
    recent = F.col("updated_at") >= as_of - F.make_interval(hours=F.lit(24))
    one = stored.agg(
        F.count("*").cast("long").alias("total_cached_docs"),
        F.count(F.when(recent, 1)).cast("long").alias("recent_recommendations"),
        F.coalesce(F.avg(F.size("recommendations").cast("double")), F.lit(0.0)).alias("avg_recommendations_per_doc"),
    )
    held = stored.where(F.size("recommendations") > 0).select("target_doc_id", F.lit(1).alias("_held"))
    asked = requests.join(held, "target_doc_id", "left").agg(F.count("*").alias("n"), F.count("_held").alias("hits"))
    both = one.unionByName(asked, allowMissingColumns=True)  # a row each
    both = both.agg(*(F.max(c).alias(c) for c in both.columns))
    ratio = F.when(F.col("n") > 0, F.col("hits") / F.col("n") * 100).otherwise(F.lit(0.0))
    return both.select(*one.columns, F.format_string("%.2f%%", ratio).alias("cache_hit_ratio"))
