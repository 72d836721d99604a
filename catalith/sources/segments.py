"""A stored search index: segments, and a manifest whose commit makes them one index.

An upsert writes one segment, in proportion to what changes: documents (in files of ranges of the id), postings (in a folder for each field; a file
holds those of a range of documents, in order of the term), deletions (a file of some terms, in order of the key), impacts (in order of the term), the ids
that it replaces in all segments before it, and counts. Counts are signed:
those of the new documents less those of the documents replaced, which are analysed again from their stored rows, so the sums
over the segments are the counts of the index and no reader has to look for what is dead. Then the manifest, a snapshot of the
segments' paths in order, is committed. Readers open what the last manifest names: they see all tables of a
segment or none, and an upsert that is lost between two tables leaves the index as it was. A merge folds the newest segments.

One writer at a time: a manifest that changed while a segment was written is an error.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.search import MAX_LITERALS, Analyzer, Index, build_index, deletion_postings, field_totals, largest_impacts, mean_lengths, run_impacts, term_counts, term_impacts
from catalith.sources.stores import _store, last_version, read_version, replace_snapshot, versions

#: Segments that an index has at most, after which the newest are merged.
MAX_SEGMENTS = 8
POSTINGS = "list_id long, len int, term string, tf int, at array<int>, field string"
MANIFEST = "at int, path string, docs long"
#: The tables of a segment.
TABLES = ("docs", "ids", "postings", "terms", "totals", "deletions", "impacts")


def write_table(df: DataFrame, path: str, order: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), ranges: bool = False) -> None:
    """Writes a table of a segment once, every file in order if one is given; with ranges, the files are ranges of it as well.

    Rows stay where they were made: a request asks every file of a table for its terms anyway, as Spark opens all footers, and
    finds them by the order within. So neither postings nor deletions are shuffled, and no range of them is sampled. A merge
    deals its rows in ranges, so that small files of many segments become few.
    """
    if order:
        df = (df.repartitionByRange(*order) if ranges else df).sortWithinPartitions(*order)
    df.write.partitionBy(*partition_by).parquet(path)


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> list[tuple[str, int]]:
    """The segments (path, documents written) of an index, the oldest first; a row for each of MAX_SEGMENTS + 1 at most."""
    version = last_version(spark, f"{folder}/manifest") if version is None else version
    rows = read_version(spark, f"{folder}/manifest", version).collect() if version else []
    return [(r["path"], r["docs"]) for r in sorted(rows, key=lambda r: r["at"])]


def commit(spark: SparkSession, folder: str, segments: list[tuple[str, int]], seen: list[tuple[str, int]]) -> None:
    """Makes segments the index; seen: those that the writer began with."""
    if manifest(spark, folder) != seen:
        raise RuntimeError(f"another writer changed {folder}")
    rows = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(segments)], MANIFEST).coalesce(1)
    replace_snapshot(rows, f"{folder}/manifest", also_empty=True)
    kept = {p for v in versions(spark, f"{folder}/manifest") for p, _ in manifest(spark, folder, v)}
    store, at = _store(spark, f"{folder}/segments")
    for f in store.listStatus(at):  # what neither this manifest nor the one before it names
        if not any(p.rstrip("/").endswith(f"/{f.getPath().getName()}") for p in kept):
            store.delete(f.getPath(), True)


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings") if table == "postings" else spark.read.parquet(f"{path}/{table}")


def _every(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (_read(spark, p, table) for p in paths))


def _live(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    """The rows of a table whose document no later segment replaces. Filters on them reach the scans."""
    parts = []
    for i, p in enumerate(paths):
        part = _read(spark, p, table)
        parts.append(part.join(_every(spark, paths[i + 1 :], "ids"), "list_id", "left_anti") if i + 1 < len(paths) else part)
    return functools.reduce(DataFrame.unionByName, parts)


def _summed(spark: SparkSession, paths: list[str], table: str, keys: list[str], counts: list[str]) -> DataFrame:
    """Signed counts added up over segments; those of one segment are sums already."""
    rows = _every(spark, paths, table)
    return rows if len(paths) == 1 else rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def read_index(spark: SparkSession, folder: str, by_field: dict[str, Analyzer] | None = None) -> Index:
    """A stored index; by_field as it was built with."""
    paths = [p for p, _ in manifest(spark, folder)]
    terms = _summed(spark, paths, "terms", ["field", "term"], ["n"]).where("n > 0")
    totals = _summed(spark, paths, "totals", ["field"], ["docs", "total"]).where("docs > 0")
    impacts = largest_impacts(_every(spark, paths, "impacts"))  # those of documents that are replaced bound as well
    return Index.stored(_live(spark, paths, "postings"), terms, mean_lengths(totals), _every(spark, paths, "deletions"), impacts, by_field)


def read_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of an index."""
    return _live(spark, [p for p, _ in manifest(spark, folder)], "docs")


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with any of the ids, which go down to the scan as literals while they are MAX_LITERALS at most."""
    few = [r["list_id"] for r in ids.limit(MAX_LITERALS + 1).collect()]
    return docs.where(F.col("list_id").isin(few)) if len(few) <= MAX_LITERALS else docs.join(ids, "list_id", "left_semi")


def upsert(
    docs: DataFrame, folder: str, fields: dict[str, str] | None = None, by_field: dict[str, Analyzer] | None = None, recreate: bool = False, removed: DataFrame | None = None
) -> int:
    """Indexes docs (one row for each list_id) in place of the documents with their ids, and takes those in removed (list_id) out; returns how many docs.

    fields, by_field: as in build_index(), the same in every call. recreate: docs are all that the index has afterwards. Rows without
    an id are left out. Without docs and removed the index stays as it is.
    """
    spark = docs.sparkSession
    seen = manifest(spark, folder)
    before = [] if recreate else seen
    path = f"{folder}/segments/{uuid.uuid4().hex}"
    write_table(docs.where("list_id is not null").withColumn("list_id", F.col("list_id").cast("long")), f"{path}/docs", ("list_id",), (), True)
    stored = _read(spark, path, "docs")
    n = stored.count()
    ids = stored.select("list_id")
    if removed is not None:
        ids = ids.unionByName(removed.select(F.col("list_id").cast("long").alias("list_id"))).distinct()
    write_table(ids, f"{path}/ids")
    ids = _read(spark, path, "ids")
    if before and ids.isEmpty():
        return 0
    write_table(build_index(stored, fields, by_field).postings, f"{path}/postings", ("field", "term", "list_id"), ("field",))
    postings = _read(spark, path, "postings")
    terms, totals = term_counts(postings), field_totals(postings)
    if before:
        old = build_index(_of_ids(read_docs(spark, folder), ids), fields, by_field).postings
        less = lambda df, cols: df.withColumns({c: -F.col(c) for c in cols})
        terms = terms.unionByName(less(term_counts(old), ["n"])).groupBy("field", "term").agg(F.sum("n").alias("n")).where("n <> 0")
        totals = totals.unionByName(less(field_totals(old), ["docs", "total"])).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
    write_table(terms, f"{path}/terms", ("term", "field"))
    write_table(totals, f"{path}/totals")
    more = _read(spark, path, "terms").where("n > 0")
    write_table(deletion_postings(more, more.count()), f"{path}/deletions", ("key", "term"))  # a term of no more documents than before is stored already
    write_table(run_impacts(postings), f"{path}/impacts", ("term", "field", "range"))
    commit(spark, folder, [*before, (path, n)], seen)
    merge(spark, folder)
    return n


def remove(spark: SparkSession, folder: str, ids: list[int], fields: dict[str, str] | None = None, by_field: dict[str, Analyzer] | None = None) -> None:
    """Takes documents out of an index."""
    gone = spark.createDataFrame([(i,) for i in ids], "list_id long")
    upsert(read_docs(spark, folder).limit(0), folder, fields, by_field, removed=gone)


def to_merge(segments: list[tuple[str, int]], most: int) -> int:
    """From which segment on all are folded, so that most stay: the newest ones, and older ones as long as they are not twice as large as what is folded."""
    if len(segments) <= most:
        return len(segments)
    at, held = len(segments) - 2, segments[-1][1] + segments[-2][1]
    while at and (len(segments) - at < 2 or segments[at - 1][1] < 2 * held or at + 1 > most):
        at -= 1
        held += segments[at][1]
    return at


def merge(spark: SparkSession, folder: str, most: int = MAX_SEGMENTS) -> bool:
    """Folds the newest segments to one if there are more than most; whether it did. A document is so rewritten a number of times that grows with the logarithm of the index."""
    segments = manifest(spark, folder)
    first = to_merge(segments, most)
    if first >= len(segments) - 1:
        return False
    paths = [p for p, _ in segments[first:]]
    path = f"{folder}/segments/{uuid.uuid4().hex}"
    write_table(_live(spark, paths, "docs"), f"{path}/docs", ("list_id",), ranges=True)
    write_table(_every(spark, paths, "ids").distinct(), f"{path}/ids")
    write_table(_live(spark, paths, "postings"), f"{path}/postings", ("field", "term", "list_id"), ("field",), ranges=True)
    write_table(_summed(spark, paths, "terms", ["field", "term"], ["n"]).where("n <> 0"), f"{path}/terms", ("term", "field"), ranges=True)
    write_table(_summed(spark, paths, "totals", ["field"], ["docs", "total"]), f"{path}/totals")
    whole = _read(spark, path, "terms")
    deletions = _every(spark, paths, "deletions").distinct() if first else deletion_postings(whole, whole.count())  # without the terms that are gone
    write_table(deletions, f"{path}/deletions", ("key", "term"), ranges=True)
    write_table(term_impacts(_read(spark, path, "postings")), f"{path}/impacts", ("term", "field", "range"), ranges=True)
    commit(spark, folder, [*segments[:first], (path, _read(spark, path, "docs").count())], segments)
    return True


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """part, segments, files and bytes of each table of an index, from the file system."""
    rows = []
    paths = [p for p, _ in manifest(spark, folder)]
    for table in TABLES:
        found = [_store(spark, f"{p}/{table}") for p in paths]
        sums = [store.getContentSummary(at) for store, at in found]
        rows.append((table, len(paths), sum(s.getFileCount() for s in sums), sum(s.getLength() for s in sums)))
    return spark.createDataFrame(rows, "part string, segments int, files long, bytes long")
