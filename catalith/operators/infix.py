"""Search for a part of a title, from an index of character n-grams.

The index is three tables: grams (gram, list_id), whose files each hold the texts of a range of ids in order of the gram; counts (gram and how many texts have it), likewise; docs
(list_id, text), in order of the id. A request's text is cut into its grams of the largest size, whose counts are
read first. The postings of the rarest gram are met with those of the next, and so on; what is in all of them is verified
in the texts of these ids alone. No request scans the texts. Letters of either case are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.search import MAX_LITERALS
from catalith.sources.stores import read_snapshot, replace_snapshot

#: Sizes of grams, so that a request of one character is a gram too.
LARGEST = 3
#: Postings that are met; what others would leave out, the texts do.
MET = 4
#: Characters of texts whose grams are made and sorted in one task, and in one file.
TASK_CHARS = 1 << 20


@dataclass(frozen=True)
class GramIndex:
    grams: DataFrame
    counts: DataFrame
    docs: DataFrame


def text_grams(text: Column) -> Column:
    """The distinct runs of one to LARGEST characters of a text in small letters; none of null and empty texts."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    runs = lambda cs: lambda c, i: F.array(*(F.concat(*(F.get(cs, i + k) for k in range(n))) for n in range(1, LARGEST + 1)))
    once = F.transform(F.array(chars), lambda cs: F.flatten(F.transform(cs, runs(cs))))  # else the text is split for each run
    return F.array_distinct(F.array_compact(F.flatten(once)))


def build_gram_index(docs: DataFrame) -> GramIndex:
    """The index of docs (list_id, text), one row for each id; rows without an id are left out, null and empty texts have no grams."""
    rows = docs.where("list_id is not null").select(F.col("list_id").cast("long").alias("list_id"), "text")
    grams = rows.select("list_id", F.explode(text_grams(F.col("text"))).alias("gram"))
    return GramIndex(grams, grams.groupBy("gram").agg(F.count("*").alias("n")), rows)


def write_gram_index(docs: DataFrame, folder: str) -> None:
    """Stores the index of docs; readers that began before go on with the version that they read."""
    spark, index = docs.sparkSession, build_gram_index(docs)
    replace_snapshot(index.docs.repartitionByRange("list_id").sortWithinPartitions("list_id"), f"{folder}/docs", also_empty=True)
    rows = read_snapshot(spark, f"{folder}/docs")
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    dealt = rows.repartitionByRange(1 + chars // TASK_CHARS, "list_id")  # texts are dealt, for their grams are many times as large
    replace_snapshot(build_gram_index(dealt).grams.sortWithinPartitions("gram", "list_id"), f"{folder}/grams", also_empty=True)
    counts = read_snapshot(spark, f"{folder}/grams").groupBy("gram").agg(F.count("*").alias("n"))
    replace_snapshot(counts.repartitionByRange("gram").sortWithinPartitions("gram"), f"{folder}/counts", also_empty=True)


def read_gram_index(spark: SparkSession, folder: str) -> GramIndex:
    return GramIndex(*(read_snapshot(spark, f"{folder}/{k}") for k in ("grams", "counts", "docs")))


def asked_grams(part: str) -> list[str]:
    """The distinct grams of a request, of the largest size that it has."""
    size = min(LARGEST, len(part))
    return sorted({part[i : i + size] for i in range(len(part) - size + 1)}) if part else []


def candidates(index: GramIndex, part: str) -> DataFrame:
    """list_id of the texts that have the MET rarest grams of a request; none if a gram is nowhere."""
    spark = index.grams.sparkSession
    small = spark.range(1).select(F.lower(F.lit(part)).alias("part")).first()["part"]  # as the texts are
    asked = asked_grams(small)
    known = index.counts.where(F.col("gram").isin(asked)).orderBy("n", "gram").collect()  # a row for each gram of the request
    if not asked or len(known) < len(asked):
        return index.grams.where("false").select("list_id")
    found = None
    for r in known[:MET]:
        having = index.grams.where(F.col("gram") == r["gram"]).select("list_id")
        found = having if found is None else having.join(found, "list_id", "left_semi")
    return found


def infix_search(index: GramIndex, part: str) -> DataFrame:
    """list_id and text of the texts that hold part; an empty part is in none."""
    found = candidates(index, part)
    few = [r["list_id"] for r in found.limit(MAX_LITERALS + 1).collect()]
    docs = index.docs.where(F.col("list_id").isin(few)) if len(few) <= MAX_LITERALS else index.docs.join(found, "list_id", "left_semi")
    return docs.where(F.contains(F.lower("text"), F.lower(F.lit(part))))
