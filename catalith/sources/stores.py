"""Writers. A snapshot is a folder of versions: a new one is written beside the old ones and readers take the last finished one.

A version is finished when Spark has committed it (its _SUCCESS file), so a reader never meets a half-written
table, what is being read is never overwritten, and a write that is lost with its executors leaves the version before it. Numbers
go on after the largest folder, finished or not, so that what a lost write left stands in nobody's way; it is removed with
the old versions. Of two writers that take one number the second fails. The version before the last is kept for those who read it still.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catalith.functions.coerce import to_kst
from catalith.sources.listings import SAVED_REQUEST

#: Versions of a snapshot that stay.
KEPT_VERSIONS = 2
#: Rows of a file of an ordered snapshot.
FILE_ROWS = 10_000


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the work folder for a table that lives as long as the session; it is removed when the driver ends."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    store, at = _store(spark, path)
    store.deleteOnExit(at)
    return path


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, as Spark's readers see it, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and last change of what is at a path, by which a reader knows that it is as it was."""
    store, at = _store(spark, path)
    summary = store.getContentSummary(at)
    found = [f.getModificationTime() for f in store.listStatus(at)]
    return summary.getFileCount(), summary.getLength(), max(found, default=0)


def _numbered(spark: SparkSession, path: str) -> dict[int, bool]:
    """The versions of a snapshot, and whether they are finished; only folder names are read."""
    store, at = _store(spark, path)
    if not store.exists(at):
        return {}
    names = [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()]
    return {int(n.removeprefix("version=")): store.exists(_store(spark, f"{path}/{n}/_SUCCESS")[1]) for n in names if n.startswith("version=")}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a snapshot."""
    return sorted(v for v, done in _numbered(spark, path).items() if done)


def last_version(spark: SparkSession, path: str) -> int:
    """The last finished version of a snapshot, 0 without one."""
    return max(versions(spark, path), default=0)


def replace_snapshot(df: DataFrame, path: str, also_empty: bool = False, partition_by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> bool:
    """Writes df as the next version; without rows nothing is written, and the old snapshot stays, unless also_empty.

    With an order each file holds a range of it, FILE_ROWS rows at most, so that a filter on its columns opens few files.
    """
    if not also_empty and df.isEmpty():
        return False
    spark = df.sparkSession
    found = _numbered(spark, path)
    writer = df.write
    if order:
        writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy(*partition_by).parquet(f"{path}/version={max(found, default=0) + 1:08d}")
    kept = sorted(v for v, done in found.items() if done)[-(KEPT_VERSIONS - 1) :]
    for v in found:
        if not kept or v < kept[0]:  # a later unfinished one may still be written
            store, at = _store(spark, f"{path}/version={v:08d}")
            store.delete(at, True)
    return True


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version:08d}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last version; the others are not read."""
    return read_version(spark, path, last_version(spark, path))


def upsert_snapshot(new: DataFrame, path: str, key: str) -> int:
    """Rows of new in place of those with their keys, the others as they are; returns the rows of new. new has one row for each key.

    The rows are counted as they are written, so the number is that of the rows of new in the store. Without any nothing is written.
    """
    if new.isEmpty():
        return 0
    spark, seen = new.sparkSession, Observation()
    marked = new.withColumn("_new", F.lit(True))
    if last_version(spark, path):
        old = read_snapshot(spark, path)
        marked = old.join(new.select(key), key, "left_anti").withColumn("_new", F.lit(False)).unionByName(marked)
    replace_snapshot(marked.observe(seen, F.count(F.when(F.col("_new"), 1)).alias("n")).drop("_new"), path, also_empty=True)
    return seen.get["n"]


def remove_one(spark: SparkSession, path: str, key: str, value: object) -> bool:
    """Removes the rows with the value from a snapshot; whether there were any."""
    rows = read_snapshot(spark, path)
    if rows.where(F.col(key) == value).isEmpty():
        return False
    return replace_snapshot(rows.where(~F.col(key).eqNullSafe(F.lit(value))), path, also_empty=True)


def remove_many(spark: SparkSession, path: str, key: str, values: list) -> int:
    """Removes the rows with any of the values from a snapshot; returns how many values were asked for, found or not."""
    if values:
        rows = read_snapshot(spark, path)
        replace_snapshot(rows.where(~F.coalesce(F.col(key).isin(list(values)), F.lit(False))), path, also_empty=True)
    return len(values)


def remove_all(spark: SparkSession, path: str) -> int:
    """Empties a snapshot; returns how many rows it had."""
    rows = read_snapshot(spark, path)
    n = rows.count()
    replace_snapshot(rows.limit(0), path, also_empty=True)
    return n


def snapshot_stats(spark: SparkSession, path: str) -> DataFrame:
    """rows, files and bytes of a snapshot, and how many versions are kept."""
    last = last_version(spark, path)
    store, at = _store(spark, f"{path}/version={last:08d}")
    summary = store.getContentSummary(at)
    found = [(summary.getFileCount(), summary.getLength(), len(versions(spark, path)))]
    return spark.createDataFrame(found, "files long, bytes long, versions int").join(read_version(spark, path, last).agg(F.count("*").alias("rows")), F.lit(True))  # one row each


def valid_requests(requests: DataFrame, as_of: Column) -> DataFrame:
    """Requests with an id or an address (0 and "" are none), stamped with the wall-clock time at UTC+9."""
    has = (F.coalesce("list_id", F.lit(0)) != 0) | (F.coalesce("url", F.lit("")) != "")
    return requests.where(has).select("list_id", "url", to_kst(as_of).alias("created_at"))


def save_request(spark: SparkSession, path: str, list_id: int | None, url: str | None, at: datetime) -> None:
    """Appends one request; ValueError if it has neither an id nor an address."""
    if not list_id and not url:
        raise ValueError("a request needs list_id or url")
    one = spark.createDataFrame([(list_id, url, at)], SAVED_REQUEST)
    valid_requests(one, F.col("created_at")).write.mode("append").parquet(path)


def create_index(df: DataFrame, name: str, recreate: bool = False) -> bool:
    """Saves a table of the session's catalog; one that exists stays unless it is to be recreated. Whether it was written."""
    exists = df.sparkSession.catalog.tableExists(name)
    if exists and not recreate:
        return False
    if exists:
        delete_index(df.sparkSession, name)
    df.write.saveAsTable(name)
    return True


def delete_index(spark: SparkSession, name: str) -> bool:
    exists = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return exists


def insert(df: DataFrame, name: str) -> int:
    """Appends to a table; returns how many rows were inserted."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").saveAsTable(name)
    return seen.get["n"]
