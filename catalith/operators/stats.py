"""Counts and coverage of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.coerce import percent


def _counted(kind: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").cast("long").alias("n")).select(F.lit(kind).alias("kind"), "n")


def coverage(api: DataFrame, file: DataFrame, api_docs: DataFrame, file_docs: DataFrame) -> DataFrame:
    """One row: listings and generated documents of each kind, and coverage in percent (0 without listings)."""
    names = {"api_data_count": api, "api_docs_count": api_docs, "file_data_count": file, "file_docs_count": file_docs}
    parts = [_counted(k, df) for k, df in names.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in names))
    data, docs = F.col("api_data_count") + F.col("file_data_count"), F.col("api_docs_count") + F.col("file_docs_count")
    return one.select(
        data.alias("total_open_data"),
        docs.alias("total_generated_docs"),
        *names,
        percent(F.col("api_docs_count"), F.col("api_data_count")).alias("api_coverage"),
        percent(F.col("file_docs_count"), F.col("file_data_count")).alias("file_coverage"),
        percent(docs, data).alias("total_coverage"),
    )


def success_rate(api: DataFrame, api_docs: DataFrame) -> DataFrame:
    """One row: API listings, their generated documents, and the rate in percent to two places (halves go up)."""
    rows = _counted("data", api).unionByName(_counted("docs", api_docs))
    n = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n"))).cast("long").alias(f"total_{k}")
    one = rows.agg(n("data"), n("docs"))
    return one.select(
        F.col("total_data").alias("total_open_data"),
        F.col("total_docs").alias("total_std_docs"),
        F.round(percent(F.col("total_docs"), F.col("total_data")), 2).alias("success_rate"),
    )


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("data_type").agg(F.count("*").cast("long").alias("n"))


def outcome_counts(done: DataFrame) -> DataFrame:
    """total, success and failed of a batch; done has the column ok."""
    ok = F.coalesce("ok", F.lit(False))
    n = lambda c: F.count(F.when(c, 1)).cast("long")
    return done.agg(F.count("*").cast("long").alias("total"), n(ok).alias("success"), n(~ok).alias("failed"))


def table_stats(df: DataFrame) -> DataFrame:
    """Documents and characters of a table of texts, its columns that are strings."""
    chars = sum((F.coalesce(F.length(k), F.lit(0)) for k, t in df.dtypes if t == "string"), F.lit(0))
    return df.agg(F.count("*").cast("long").alias("documents"), F.coalesce(F.sum(chars), F.lit(0)).cast("long").alias("characters"))
