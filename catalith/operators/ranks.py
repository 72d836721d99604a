"""Rankings: rows of both kinds, sorted, cut and numbered, and how many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.coerce import falsy_or, int_or_zero, timestamp_or_null, trending_score, truthy_id
from catalith.operators.lookup import lookup_last
from catalith.operators.paging import Page
from catalith.sources.stores import scratch

#: Rows kept of each ranking.
KEPT = {"latest": 200_000, "popular": 200_000, "trending": 1_000}
#: Rows that are ranked in one task, and rows of a file of the sorted rows beyond.
ONE_TASK, RANGE_FILE_ROWS = 1_000, 100_000
#: Fixed value: the bits of Spark's increasing ids that number a partition's rows.
PLACE_BITS = 33


def rank_rows(api: DataFrame, file: DataFrame, api_docs: DataFrame, file_docs: DataFrame) -> DataFrame:
    """A row for each listing of either kind, colliding ids included, with its last generated document.

    A FILE row without an id has id 0; empty FILE titles and offices fall back like null ones.
    """

    def of(kind: str, listing: DataFrame, docs: DataFrame, title: Column, org: Column, popularity: str) -> DataFrame:
        rows = listing.withColumn("list_id", int_or_zero(F.col("list_id")))
        known = docs.select("list_id", F.col("token_count").alias("_tokens"), F.lit(True).alias("_has"))
        return lookup_last(rows, known, "list_id", ["_tokens"]).select(
            "list_id",
            F.lit(kind).alias("data_type"),
            title.alias("list_title"),
            org.alias("org_nm"),
            F.coalesce("_tokens", F.lit(0)).cast("long").alias("token_count"),
            F.coalesce("_has", F.lit(False)).alias("has_generated_doc"),
            "created_at",
            "updated_at",
            F.lit(None).cast("timestamp").alias("generated_at"),  # of a snapshot row it is never known
            int_or_zero(F.col(popularity)).cast("double").alias("popularity_score"),
        )

    c = F.col
    return of("API", api, api_docs, c("list_title"), c("org_nm"), "request_cnt").unionByName(
        of("FILE", file, file_docs, falsy_or(c("list_title"), c("title")), falsy_or(c("org_nm"), c("dept_nm")), "download_cnt")
    )


def ranked(rows: DataFrame, key: Column, keep: int) -> DataFrame:
    """The keep rows of the largest key, numbered from 1; nulls come last, ties go by id, kind and title, and rows equal in all of them in any order.

    Up to ONE_TASK rows are cut and numbered in one task. More are sorted by ranges of the whole order, so that a key that many
    rows share is in many tasks, and written once; a row's number is its place in its range after the rows of the ranges before it.
    """
    order = [F.col("_key").desc_nulls_last(), F.col("list_id").asc(), F.col("data_type").asc(), F.col("list_title").asc()]
    keyed = rows.withColumn("_key", key)
    if keep > ONE_TASK:
        return _ranked_by_range(keyed, order, keep).drop("_key")
    return keyed.orderBy(*order).limit(keep).withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_key")


def _ranked_by_range(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """As ranked. Only counts of ranges, of which a shuffle has a bounded number, come to the driver; ranges beyond keep are not read again."""
    spark = rows.sparkSession
    path = scratch(spark, "ranked")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.option("maxRecordsPerFile", RANGE_FILE_ROWS).parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    in_range = F.shiftright("_at", PLACE_BITS)
    before, ranges, last = 0, [], -1
    for at, n in sorted(written.groupBy(in_range).agg(F.count("*")).collect()):
        ranges.append((at, (at << PLACE_BITS) - before - 1))
        last = (at << PLACE_BITS) + min(n, keep - before) - 1
        before += n
        if before >= keep:
            break
    base = spark.createDataFrame(ranges, "_range long, _base long")
    kept = written.where(F.col("_at") <= last).withColumn("_range", in_range)  # goes down to the scan: _at ascends from file to file
    return kept.join(F.broadcast(base), "_range").withColumn("rank", (F.col("_at") - F.col("_base")).cast("int")).drop("_at", "_range", "_base")


def rank_latest(rows: DataFrame, as_of: Column, keep: int = KEPT["latest"]) -> DataFrame:
    """By the last update, else as_of; when a listing was created does not matter."""
    return ranked(rows, F.coalesce("updated_at", as_of), keep)


def rank_popular(rows: DataFrame, keep: int = KEPT["popular"]) -> DataFrame:
    return ranked(rows, F.coalesce("popularity_score", F.lit(0.0)), keep)


def rank_trending(rows: DataFrame, as_of: Column, keep: int = KEPT["trending"]) -> DataFrame:
    """By popularity decayed with the time since the last update; what has none counts as updated at as_of, an hour ago at least."""
    score = trending_score(F.coalesce("popularity_score", F.lit(0.0)), F.coalesce("updated_at", as_of), as_of)
    return ranked(rows.withColumn("trending_score", score), F.col("trending_score"), keep)


def coerced_items(rows: DataFrame) -> DataFrame:
    """Rows of listings or rankings with typed values: an unknown data_type is API, counts and scores are integers (0 for none), dates dates, a missing rank stays missing."""
    known = F.when(F.col("data_type").isin("API", "FILE"), F.col("data_type")).otherwise(F.lit("API"))
    typed = {
        "data_type": known,
        **{k: int_or_zero(F.col(k)) for k in ("token_count", "popularity_score") if k in rows.columns},
        **{k: timestamp_or_null(F.col(k).cast("string")) for k in ("updated_at", "generated_at") if k in rows.columns},
    }
    if "rank" in rows.columns:
        typed["rank"] = F.when(F.col("rank").isNotNull(), int_or_zero(F.col("rank")))
    return rows.withColumns(typed)


def distinct_listings(rows: DataFrame) -> DataFrame:
    """total: the distinct ids that are neither null nor 0."""
    return rows.agg(F.countDistinct(F.when(truthy_id(F.col("list_id")), F.col("list_id"))).cast("long").alias("total"))


def rank_metadata(rows: DataFrame, as_of: Column) -> DataFrame:
    """A row for each ranking; total_count is the number of distinct listings, whatever the ranking keeps."""
    total = distinct_listings(rows)
    names = F.explode(F.array(*(F.lit(k) for k in KEPT)))
    return total.select(names.alias("sort_type"), F.col("total").alias("total_count"), as_of.alias("last_updated"))


def rank_counts(rows: DataFrame) -> DataFrame:
    """Rows of each ranking before it is cut."""
    n = F.count("*").cast("long")
    return rows.agg(*(n.alias(k) for k in KEPT))


def snapshot_page(snapshot: DataFrame, page: Page) -> DataFrame:
    """A page of a stored ranking: its ranks, which the scan gets, as a ranking is stored in their order. No token count reads as 0, no flag as false."""
    rows = snapshot.where(F.col("rank").between(page.offset + 1, page.offset + page.size)).orderBy("rank")
    return rows.select(
        "list_id",
        "list_title",
        "org_nm",
        F.coalesce("token_count", F.lit(0)).cast("long").alias("token_count"),
        F.coalesce("has_generated_doc", F.lit(False)).alias("has_generated_doc"),
        "data_type",
    )


def ranked_or_live(snapshot: DataFrame, metadata: DataFrame, sort_type: str, live: tuple[DataFrame, DataFrame], page: Page) -> tuple[DataFrame, DataFrame]:
    """The rows of a page and its total: from the stored ranking within its window, beyond it from live, the page as it is now.

    The total is the ranking's where it has one, also beyond the window; else the number of rows that live is cut from
    must come with it: live is (rows of the page, total).
    """
    stored = metadata_total(metadata, sort_type)
    rows, counted = live
    if page.in_snapshot:
        return snapshot_page(snapshot, page), stored
    both = stored.withColumn("o", F.lit(0)).unionByName(counted.select(F.col("total").cast("long").alias("total")).withColumn("o", F.lit(1)))
    return rows, both.agg(F.coalesce(F.max(F.when((F.col("o") == 0) & (F.col("total") > 0), F.col("total"))), F.max(F.when(F.col("o") == 1, F.col("total")))).alias("total"))


def metadata_total(metadata: DataFrame, sort_type: str) -> DataFrame:
    """The total of a ranking, 0 if it was never built."""
    return metadata.where(F.col("sort_type") == sort_type).agg(F.coalesce(F.max("total_count"), F.lit(0)).cast("long").alias("total"))
