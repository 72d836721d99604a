"""Pages: clamped arguments, an offset and a limit over a total order, and the facts of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest page, and the rows of a ranking that pages are served from.
MAX_SIZE, SNAPSHOT_ROWS = 100, 1000


@dataclass(frozen=True)
class Page:
    number: int
    size: int

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size

    @property
    def in_snapshot(self) -> bool:
        """Whether a ranking serves this page, or a live query must."""
        return self.number <= SNAPSHOT_ROWS // self.size


def clamp(number: int, size: int) -> Page:
    """Numbers from 1, sizes from 1 to MAX_SIZE; what lies outside goes to the nearer end."""
    return Page(max(1, number), min(MAX_SIZE, max(1, size)))


def checked(number: int, size: int) -> Page:
    """As clamp, but what lies outside is an error."""
    if number < 1 or not 1 <= size <= MAX_SIZE:
        raise ValueError(f"page {number} of {size} rows: pages count from 1, with 1 to {MAX_SIZE} rows")
    return Page(number, size)


def take(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """One page in order; each task keeps the rows up to its end only."""
    return df.orderBy(*order).offset(page.offset).limit(page.size)


def facts(total: int, page: Page) -> dict[str, int | bool]:
    pages = -(-total // page.size)
    if page.number > max(1, pages):
        raise ValueError(f"there are {pages} pages")
    return {"total": total, "page": page.number, "size": page.size, "total_pages": pages, "has_next": page.number < pages, "has_prev": page.number > 1}


def facts_frame(counted: DataFrame, page: Page) -> DataFrame:
    """The facts of a page as a row; counted has the column total."""
    pages = F.ceil(F.col("total") / page.size).cast("long")
    number = F.lit(page.number).cast("long")
    return counted.select(
        F.col("total").cast("long").alias("total"),
        number.alias("page"),
        F.lit(page.size).cast("long").alias("size"),
        pages.alias("total_pages"),
        (number < pages).alias("has_next"),
        (number > 1).alias("has_prev"),
    )


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of rows that the caller states."""
    return spark.createDataFrame(rows, schema)
