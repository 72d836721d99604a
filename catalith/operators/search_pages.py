"""Search results joined with the listings and generated documents they stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions.coerce import falsy_or, iso
from catalith.operators.lookup import dedup_last, id_union, lookup_last
from catalith.operators.search import top

#: Hits fetched for each row of a page (MIN_HITS at least), and rows that pages are cut from.
OVERFETCH, MIN_HITS, CAP = 3, 10, 2
#: Hits whose ids go down to the scans of what they are joined with.
MAX_IDS = 1_000


def _of_hits(hits: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """hits, found once, and the rows of the tables with their ids; all as they are where hits are more than MAX_IDS, no page."""
    few = hits.limit(MAX_IDS + 1).collect()
    if len(few) > MAX_IDS:
        return hits, *tables
    ids = sorted({r["list_id"] for r in few} - {None})
    return hits.sparkSession.createDataFrame(few, hits.schema), *(t.where(F.col("list_id").isin(ids)) for t in tables)


def _known(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    kept = df.where("list_id is not null").select("list_id", *(F.col(c).alias(f"{prefix}_{c}") for c in columns), F.lit(True).alias(f"{prefix}"))
    return dedup_last(kept, ["list_id"], [f"{prefix}_{c}" for c in columns])


def found_listings(hits: DataFrame, docs: DataFrame, api: DataFrame, file: DataFrame, api_docs: DataFrame, file_docs: DataFrame) -> DataFrame:
    """A row for each hit (list_id, score): what it is by its API listing, else its FILE listing, else its generated FILE document, else nothing more than the index has.

    docs: what the index was built from. A hit with only a generated API document counts as one without.
    """
    hits, docs, api, file, api_docs, file_docs = _of_hits(hits, docs, api, file, api_docs, file_docs)
    source = dedup_last(docs.select("list_id", F.col("list_title").alias("_title"), F.col("org_nm").alias("_org"), F.col("data_type").alias("_kind")), ["list_id"], ["_kind", "_title"])
    rows = hits.join(source, "list_id", "left")
    for known in (
        _known(api, "a", ["list_title", "org_nm"]),
        _known(file, "f", ["list_title", "org_nm"]),
        _known(api_docs, "ga", ["token_count", "generated_at"]),
        _known(file_docs, "gf", ["token_count", "generated_at"]),
    ):
        rows = rows.join(known, "list_id", "left")
    c = F.col
    is_api, is_file, is_doc = c("a").isNotNull(), c("f").isNotNull(), c("gf").isNotNull()
    pick = lambda a, f, g, none: F.when(is_api, a).when(is_file, f).when(is_doc, g).otherwise(none)
    return rows.select(
        "list_id",
        pick(c("a_list_title"), c("f_list_title"), F.coalesce("_title", F.lit("")), F.coalesce("_title", F.lit(""))).alias("list_title"),
        pick(c("a_org_nm"), c("f_org_nm"), c("_org"), F.lit(None)).alias("org_nm"),
        F.coalesce(pick(c("ga_token_count"), c("gf_token_count"), c("gf_token_count"), F.lit(0)), F.lit(0)).cast("long").alias("token_count"),
        pick(c("ga").isNotNull(), is_doc, F.lit(True), F.lit(False)).alias("has_generated_doc"),
        iso(pick(c("ga_generated_at"), c("gf_generated_at"), c("gf_generated_at"), F.lit(None))).alias("updated_at"),
        pick(F.lit("API"), F.lit("FILE"), F.lit("FILE"), F.coalesce("_kind", F.lit("API"))).alias("data_type"),
        "score",
    )


def fetched(size: int, overfetch: int = OVERFETCH) -> int:
    """Hits that a page of size rows is chosen from."""
    return max(overfetch * size, MIN_HITS)


def documented_page(
    hits: DataFrame, docs: DataFrame, api: DataFrame, file: DataFrame, api_docs: DataFrame, file_docs: DataFrame, page: int, size: int, overfetch: int | None = OVERFETCH
) -> DataFrame:
    """A page of the hits that have a generated document, with the title of the listing of its kind.

    Pages are cut from the first CAP * size such rows among the first overfetch * size hits, so later ones are
    empty; overfetch None: from all hits.
    """
    if overfetch is not None:
        hits, docs, api, file, api_docs, file_docs = _of_hits(top(hits, fetched(size, overfetch)), docs, api, file, api_docs, file_docs)
    chosen = hits.join(id_union(api_docs.select("list_id"), file_docs.select("list_id")), "list_id", "left_semi")
    if overfetch is not None:
        chosen = top(chosen, CAP * size)
    chosen, docs, api, file, api_docs, file_docs = _of_hits(top(chosen, size, (page - 1) * size), docs, api, file, api_docs, file_docs)
    source = docs.select("list_id", F.col("list_title").alias("_list_title"), F.col("title").alias("_title"))
    rows = chosen.join(dedup_last(source, ["list_id"], ["_list_title", "_title"]), "list_id", "left")
    generated = [d.select("list_id", F.lit(True).alias(k)).distinct() for k, d in (("_api", api_docs), ("_file", file_docs))]
    rows = rows.join(generated[0], "list_id", "left").join(generated[1], "list_id", "left")
    listed = [x.select("list_id", *(F.col(c).alias(f"{k}_{c}") for c in ("list_title", "title", "org_nm"))) for k, x in (("a", api), ("f", file))]
    for k, x in zip("af", listed, strict=True):
        rows = lookup_last(rows, x.where("list_id is not null"), "list_id", [f"{k}_list_title", f"{k}_title"])
    of_api = F.col("_api").isNotNull()
    pick = lambda c: F.when(of_api, F.col(f"a_{c}")).otherwise(F.col(f"f_{c}"))
    return rows.select(
        "list_id",
        falsy_or(pick("list_title"), F.coalesce("_list_title", F.lit(""))).alias("list_title"),
        pick("org_nm").alias("org_nm"),
        falsy_or(pick("title"), F.coalesce("_title", F.lit(""))).alias("title"),
        "score",
        F.when(of_api, "API").otherwise("FILE").alias("data_type"),
    )


def search_or_browse(text: str | None, search: Callable[[str], DataFrame], browse: Callable[[], DataFrame]) -> DataFrame:
    """search of the text without white space at its ends, or browse where nothing is left of it."""
    return search(text.strip()) if text and text.strip() else browse()


def by_popularity(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with the unified row of their id, the most popular first; rows: one for each list_id."""
    return hits.join(rows, "list_id").orderBy(F.col("popularity").desc(), F.col("list_id").asc())
