"""Lookups that keep one match, and deduplication with a stated winner.

Each is a row-number window over the key; Spark cuts every partition to one row for each key before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order; null is a key like any other."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_one(df, keys, [F.col(c).asc_nulls_last() for c in order])


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as if later rows overwrote earlier ones."""
    return keep_one(df, keys, [F.col(c).desc_nulls_first() for c in order])


def lookup_first(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """left with the columns of the first match of right; rows without a match stay, no row is multiplied."""
    return left.join(dedup_first(right, [key], order), key, "left")


def lookup_last(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    return left.join(dedup_last(right, [key], order), key, "left")


def point(df: DataFrame, key: str, value: object, order: list[str]) -> DataFrame:
    """The first row with the value, or none."""
    return df.where(F.col(key) == value).orderBy(*order).limit(1)


def points(df: DataFrame, key: str, values: list) -> DataFrame:
    """All rows with one of the values; the list reaches the scan."""
    return df.where(F.col(key).isin(list(values)))


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ids."""
    return df.join(ids.select(key), key, "left_semi")


def id_union(*ids: DataFrame) -> DataFrame:
    """The distinct ids of one-column tables."""
    out = ids[0]
    for more in ids[1:]:
        out = out.union(more)
    return out.distinct()
