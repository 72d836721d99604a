"""The unified catalog: two kinds of listings with their generated documents, sorted and cut to pages.

Inputs (see sources.listings for their schemas): api and file listings, and a table of generated documents for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.coerce import falsy_or, int_or_zero, iso, list_or_empty, null_or, spaced_title, text_list, timestamp_or_null
from catalith.operators.lookup import dedup_first, dedup_last, lookup_first
from catalith.operators.paging import Page, take

#: What sort_by accepts, and the columns that a sort may name.
SORTS = ("popular", "trending", "all")
SORT_COLUMNS = ("list_title", "org_nm", "data_type", "token_count", "has_generated_doc")


def _documented(kind: str, listing: DataFrame, generated: DataFrame, title: Column, org: Column, popularity: Column) -> DataFrame:
    documents = generated.select("list_id", F.col("token_count").alias("_tokens"), "generated_at", F.lit(True).alias("_has"))
    found = lookup_first(listing, documents, "list_id", ["_tokens", "generated_at"])
    return found.select(
        "list_id",
        title.alias("list_title"),
        org.alias("org_nm"),
        int_or_zero(popularity).alias("popularity"),
        "updated_at",
        F.coalesce("_tokens", F.lit(0)).cast("long").alias("token_count"),
        F.coalesce("_has", F.lit(False)).alias("has_generated_doc"),
        "generated_at",
        F.lit(kind).alias("data_type"),
        F.lit(0 if kind == "API" else 1).alias("_source"),
    )


def unified(api: DataFrame, file: DataFrame, api_docs: DataFrame, file_docs: DataFrame) -> DataFrame:
    """All listings, API before FILE (_source), each with its first generated document; no listing is lost or doubled.

    FILE titles and offices fall back where they are null; an empty string stays.
    """
    c = F.col
    first = _documented("API", api, api_docs, c("list_title"), c("org_nm"), c("request_cnt"))
    second = _documented("FILE", file, file_docs, null_or(c("list_title"), c("title")), null_or(c("org_nm"), c("dept_nm")), c("download_cnt"))
    return first.unionByName(second)


def keep_first(rows: DataFrame) -> DataFrame:
    """One row for each list_id: API wins over FILE."""
    return dedup_first(rows, ["list_id"], ["_source", "list_title", "org_nm", "popularity", "updated_at"])


def keep_last(rows: DataFrame) -> DataFrame:
    """One row for each list_id: FILE, written later, wins over API."""
    return dedup_last(rows, ["list_id"], ["_source", *(x for x in ("list_title", "org_nm", "title", "desc") if x in rows.columns)])


def by_sort(sort_by: str) -> list[Column]:
    """popular: by popularity; trending and all: by the last update, undated rows last. Ties go to smaller ids."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {', '.join(SORTS)}")
    key = F.coalesce("popularity", F.lit(0)).desc() if sort_by == "popular" else F.col("updated_at").desc_nulls_last()
    return [key, F.col("list_id").asc(), F.col("_source").asc()]


def by_columns(asked: dict[str, str], default: str = "updated_at", ascending: bool = False) -> list[Column]:
    """Sort keys in the fixed order of SORT_COLUMNS, asc or desc each, then the default, then the id."""
    if bad := [k for k, v in asked.items() if k not in SORT_COLUMNS or v not in ("asc", "desc")]:
        raise ValueError(f"cannot sort by {bad}")
    keys = [(F.col(k).asc_nulls_first() if asked[k] == "asc" else F.col(k).desc_nulls_last()) for k in SORT_COLUMNS if k in asked]
    return [*keys, F.col(default).asc_nulls_first() if ascending else F.col(default).desc_nulls_last(), F.col("list_id").asc()]


def live_page(rows: DataFrame, sort_by: str, page: Page) -> DataFrame:
    """A page of the unified catalog, from the listings as they are now."""
    return take(keep_first(rows), by_sort(sort_by), page).drop("_source")


def formatted(items: DataFrame) -> DataFrame:
    """What a list shows: underscores in titles as spaces, updated_at from the generated document, no score."""
    return items.select(
        "list_id",
        spaced_title(F.col("list_title")).alias("list_title"),
        "org_nm",
        "token_count",
        "has_generated_doc",
        iso(F.col("generated_at")).alias("updated_at"),
        "data_type",
        F.lit(None).cast("double").alias("score"),
    )


def camel_case(df: DataFrame) -> DataFrame:
    """Columns as fields of a response: list_id becomes listId."""
    return df.withColumnsRenamed({c: c.split("_")[0] + "".join(x.title() for x in c.split("_")[1:]) for c in df.columns if "_" in c.strip("_")})


def typed_rows(kind: str, listing: DataFrame, generated: DataFrame) -> DataFrame:
    """Listings as typed rows of one schema, each with its first generated document: 22 columns.

    Bad and missing integers are 0, bad dates null, keywords always a list. API texts stay null where they are null
    but for the department and the status; a FILE's are empty, its title falls back to title, its department is the
    office, else the department.
    """
    api = kind == "API"
    c = F.col
    text = lambda name: (c(name) if name in listing.columns else F.lit(None)).cast("string")
    empty = lambda x: F.coalesce(x, F.lit(""))
    of_kind = lambda x: x if api else empty(x)
    documents = generated.select("list_id", F.col("token_count").alias("_tokens"), F.lit(True).alias("_has"))
    rows = lookup_first(listing, documents, "list_id", ["_tokens"])
    return rows.select(
        int_or_zero(c("list_id")).alias("list_id"),
        (c("list_title") if api else empty(falsy_or(c("list_title"), text("title")))).alias("title"),
        of_kind(text("desc")).alias("description"),
        (empty(text("dept_nm")) if api else empty(falsy_or(text("org_nm"), text("dept_nm")))).alias("department"),
        of_kind(text("category_nm" if api else "new_category_nm")).alias("category"),
        F.lit(kind).alias("data_type"),
        of_kind(text("data_format" if api else "data_type")).alias("data_format"),
        text("is_charged").alias("pricing"),
        text("is_copyrighted").alias("copyright"),
        of_kind(text("is_third_party_copyrighted")).alias("third_party_copyright"),
        (text_list(listing, "keywords") if "keywords" in listing.columns else F.array().cast("array<string>")).alias("keywords"),
        empty(text("register_status")).alias("register_status"),
        int_or_zero(c("request_cnt" if api else "download_cnt")).alias("request_cnt"),
        *(timestamp_or_null(c(k).cast("string")).alias(k) for k in ("created_at", "updated_at")),
        (text("use_prmisn_ennc") if api else empty(text("ownership_grounds"))).alias("use_prmisn_ennc"),
        (text("title_en") if api else F.lit(None).cast("string")).alias("title_en"),
        (text("api_type") if api else F.lit("FILE")).alias("api_type"),
        F.lit(None).cast("array<string>").alias("endpoints"),
        F.coalesce("_has", F.lit(False)).alias("has_generated_doc"),
        F.coalesce("_tokens", F.lit(0)).cast("long").alias("token_count"),
        F.lit(None).cast("double").alias("score"),
    )


def search_documents(api: DataFrame, file: DataFrame) -> DataFrame:
    """The documents that the text index holds, one for each list_id (the FILE one where both kinds have it)."""

    def of(kind: str, listing: DataFrame, renamed: dict[str, str]) -> DataFrame:
        col = lambda k: F.col(renamed.get(k, k)) if renamed.get(k, k) in listing.columns else F.lit(None)
        names = ("list_title", "title", "category_nm", "dept_nm", "org_nm", "desc", "data_format")
        kind_of = col("api_type").cast("string") if kind == "API" else F.lit("FILE")
        keywords = list_or_empty(F.col("keywords")) if "keywords" in listing.columns else F.array().cast("array<string>")
        return listing.select(
            F.col("list_id").cast("long").alias("list_id"),
            *(col(k).cast("string").alias(k) for k in names),
            kind_of.alias("api_type"),
            keywords.alias("keywords"),
            F.lit(kind).alias("data_type"),
            F.lit(0 if kind == "API" else 1).alias("_source"),
        )

    both = of("API", api, {"title": "title_en"}).unionByName(of("FILE", file.where("list_id is not null"), {"category_nm": "new_category_nm", "data_format": "data_type"}))
    return keep_last(both).drop("_source")


def generated_page(api_docs: DataFrame, file_docs: DataFrame, page: Page, list_ids: list[int] | None = None) -> DataFrame:
    """A page of each kind of generated documents, one after the other: up to twice the size."""
    sides = []
    for kind, docs in (("API", api_docs), ("FILE", file_docs)):
        chosen = docs if not list_ids else docs.where(F.col("list_id").isin(list_ids))
        sides.append(take(chosen, [F.col("list_id").asc(), F.col("token_count").asc()], page).withColumn("data_type", F.lit(kind)))
    return sides[0].unionByName(sides[1], allowMissingColumns=True)
