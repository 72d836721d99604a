"""Queries of the catalog: pages, lookups, rankings, details and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.coerce import ids_of_digits, int_or_zero, iso, text_list, timestamp_or_null
from catalith.operators import detail, listing, lookup, paging, ranks, stats
from catalith.plans.tables import AS_OF, CATALOG_SQL, Catalog, as_of, iso_sql, table
from catalith.sources import stores

PAGE = paging.clamp(3, 20)
SHOWN = ["list_id", "list_title", "org_nm", "popularity", "token_count", "has_generated_doc", "data_type"]
SHOWN_SQL = ", ".join(SHOWN)
BASE_URL = "https://catalog.example.org/data"
QUERIES, ORACLES = {}, {}


def query(sql: str):  # noqa: ANN201
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def with_catalog(sql: str) -> str:
    return f"WITH {CATALOG_SQL}\n{sql}"


@query(with_catalog(f"SELECT {SHOWN_SQL} FROM kept ORDER BY popularity DESC, list_id LIMIT 20 OFFSET 40"))
def catalog_popular_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.live_page(listing.unified(*Catalog(spark, sf_dir).all), "popular", PAGE).select(SHOWN)


@query(with_catalog(f"SELECT {SHOWN_SQL} FROM kept ORDER BY updated_at DESC NULLS LAST, list_id LIMIT 20 OFFSET 40"))
def catalog_recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.live_page(listing.unified(*Catalog(spark, sf_dir).all), "trending", PAGE).select(SHOWN)


@query(with_catalog(f"SELECT {SHOWN_SQL} FROM kept ORDER BY org_nm NULLS FIRST, token_count DESC NULLS LAST, updated_at DESC NULLS LAST, list_id LIMIT 20 OFFSET 40"))
def catalog_multi_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.keep_first(listing.unified(*Catalog(spark, sf_dir).all))
    return paging.take(rows, listing.by_columns({"token_count": "desc", "org_nm": "asc"}), PAGE).select(SHOWN)


@query(with_catalog(f"""SELECT list_id AS "listId", replace(list_title, '_', ' ') AS "listTitle", org_nm AS "orgNm", token_count AS "tokenCount", has_generated_doc AS "hasGeneratedDoc",
{iso_sql('generated_at')} AS "updatedAt", data_type AS "dataType", NULL::DOUBLE AS score FROM kept ORDER BY popularity DESC, list_id LIMIT 20 OFFSET 40"""))
def catalog_formatted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.camel_case(listing.formatted(listing.live_page(listing.unified(*Catalog(spark, sf_dir).all), "popular", PAGE)))


@query(with_catalog("SELECT total, 3::BIGINT AS page, 20::BIGINT AS size, ceil(total / 20.0)::BIGINT AS total_pages, 3 < ceil(total / 20.0) AS has_next, true AS has_prev FROM (SELECT count(*) AS total FROM kept)"))
def catalog_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.keep_first(listing.unified(*Catalog(spark, sf_dir).all))
    return paging.facts_frame(rows.agg(F.count("*").alias("total")), PAGE)


TYPED = [
    "list_id", "title", "description", "department", "category", "data_type", "data_format", "pricing", "copyright", "third_party_copyright", "keywords", "register_status", "request_cnt", "created_at",
    "updated_at", "use_prmisn_ennc", "title_en", "api_type", "endpoints", "has_generated_doc", "token_count", "score",
]


@query(with_catalog(f"""SELECT list_id, list_title AS title, "desc" AS description, coalesce(dept_nm, '') AS department, category_nm AS category, 'API' AS data_type, data_format, is_charged AS pricing, is_copyrighted AS copyright,
is_third_party_copyrighted AS third_party_copyright, array_to_string(coalesce(keywords, []), '|') AS keywords, coalesce(register_status, '') AS register_status, coalesce(request_cnt, 0) AS request_cnt,
{iso_sql('created_at')} AS created_at, {iso_sql('updated_at')} AS updated_at, use_prmisn_ennc, title_en, api_type, NULL::VARCHAR AS endpoints, g.list_id IS NOT NULL AS has_generated_doc, coalesce(token_count, 0) AS token_count, NULL::DOUBLE AS score
FROM api LEFT JOIN gapi g USING (list_id)
UNION ALL SELECT list_id, coalesce(nullif(list_title, ''), title, ''), coalesce("desc", ''), coalesce(nullif(org_nm, ''), dept_nm, ''), coalesce(new_category_nm, ''), 'FILE', coalesce(data_type, ''), is_charged, is_copyrighted,
coalesce(is_third_party_copyrighted, ''), array_to_string(coalesce(keywords, []), '|'), coalesce(register_status, ''), coalesce(download_cnt, 0), {iso_sql('created_at')}, {iso_sql('updated_at')}, coalesce(ownership_grounds, ''), NULL, 'FILE',
NULL, g.list_id IS NOT NULL, coalesce(token_count, 0), NULL FROM file LEFT JOIN gfile g USING (list_id)"""))
def typed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    both = listing.typed_rows("API", c.api, c.api_docs).unionByName(listing.typed_rows("FILE", c.file, c.file_docs))
    lists, times = {k: F.array_join(k, "|") for k in ("keywords", "endpoints")}, {k: iso(F.col(k)) for k in ("created_at", "updated_at")}
    return both.withColumns(lists | times).select(TYPED)


INDEXED = ["list_id", "list_title", "title", "category_nm", "dept_nm", "org_nm", "desc", "data_format", "api_type", "keywords", "data_type"]


@query(with_catalog("""SELECT * EXCLUDE (src, r) FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY src DESC) AS r FROM (
SELECT list_id, list_title, title_en AS title, category_nm, dept_nm, org_nm, "desc", data_format, api_type, array_to_string(coalesce(keywords, []), '|') AS keywords, 'API' AS data_type, 0 AS src FROM api
UNION ALL SELECT list_id, list_title, title, new_category_nm, dept_nm, org_nm, "desc", data_type, 'FILE', array_to_string(coalesce(keywords, []), '|'), 'FILE', 1 FROM file)) WHERE r = 1"""))
def index_docs_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return listing.search_documents(c.api, c.file).withColumn("keywords", F.array_join("keywords", "|")).select(INDEXED)


@query(with_catalog(f"""SELECT * FROM (SELECT list_id, token_count, {iso_sql('generated_at')} AS generated_at, 'API' AS data_type FROM gapi ORDER BY list_id LIMIT 10 OFFSET 10)
UNION ALL SELECT * FROM (SELECT list_id, token_count, {iso_sql('generated_at')}, 'FILE' FROM gfile ORDER BY list_id LIMIT 10 OFFSET 10)"""))
def std_docs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return listing.generated_page(c.api_docs, c.file_docs, paging.clamp(2, 10)).select("list_id", "token_count", iso(F.col("generated_at")).alias("generated_at"), "data_type")


DETAIL = [
    "list_id", "data_type", "list_title", "detail_url", "generated_status", "created_at", "updated_at", "description", "org_nm", "dept_nm", "is_charged", "share_scope_nm", "keywords", "token_count", "generated_at", "markdown",
]
_OF_API = "list_title, true AS gen, \"desc\" AS d, org_nm, dept_nm, is_charged, keywords, created_at, updated_at"
_OF_FILE = "coalesce(nullif(list_title, ''), title) AS list_title, true AS gen, \"desc\" AS d, org_nm, dept_nm, is_charged, keywords, created_at, updated_at"


@query(with_catalog(f"""SELECT list_id, data_type, list_title, '{BASE_URL}/' || list_id || CASE WHEN data_type = 'API' THEN '/openapi.do' ELSE '/fileData.do' END AS detail_url, gen AS generated_status,
{iso_sql('created_at')} AS created_at, {iso_sql('updated_at')} AS updated_at, replace(nullif(d, ''), '<br/>', chr(10)) AS description, org_nm, dept_nm, is_charged, NULL::VARCHAR AS share_scope_nm,
array_to_string(coalesce(keywords, []), '|') AS keywords, token_count, {iso_sql('generated_at')} AS generated_at, markdown FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY o) AS r FROM (
SELECT g.list_id, 'API' AS data_type, {_OF_API}, token_count, generated_at, markdown, 0 AS o FROM gapi g LEFT JOIN api USING (list_id)
UNION ALL SELECT g.list_id, 'FILE', {_OF_FILE}, token_count, generated_at, markdown, 1 FROM gfile g LEFT JOIN file USING (list_id)
UNION ALL SELECT list_id, 'API', {_OF_API.replace('true', 'false')}, 0, NULL, NULL, 2 FROM api
UNION ALL SELECT list_id, 'FILE', {_OF_FILE.replace('true', 'false')}, 0, NULL, NULL, 3 FROM file)) WHERE r = 1"""))
def doc_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = {k: iso(F.col(k)) for k in ("created_at", "updated_at", "generated_at")}
    return detail.details(*Catalog(spark, sf_dir).all, BASE_URL).withColumns(times | {"keywords": F.array_join("keywords", "|")}).select(DETAIL)


ITEMS = ["l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *ITEMS)


def _lookup_sql(order: str) -> str:
    over = ", ".join(f"{c} {order}" for c in ITEMS)
    return f"""SELECT o_orderkey, {", ".join(ITEMS)} FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {over}) AS r FROM lineitem) ON l_orderkey = o_orderkey AND r = 1"""


@query(_lookup_sql("ASC"))
def lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup_first(table(spark, sf_dir, "orders").select("o_orderkey"), _lines(spark, sf_dir), "o_orderkey", ITEMS)


@query(_lookup_sql("DESC"))
def lookup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup_last(table(spark, sf_dir, "orders").select("o_orderkey"), _lines(spark, sf_dir), "o_orderkey", ITEMS)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 77, 140, 999999999)")
def lookup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.points(table(spark, sf_dir, "orders"), "o_orderkey", [1, 5, 77, 140, 999999999]).select("o_orderkey", "o_orderstatus")


@query("SELECT count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels UNION SELECT page_id * 7 FROM pages)")
def generated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    ids = lookup.id_union(c.api_docs.select("list_id"), c.file.select("list_id"))
    return lookup.among(c.api, ids, "list_id").agg(F.count("*").alias("n"))


RANKED = ["rank", "list_id", "data_type", "list_title", "org_nm", "token_count", "has_generated_doc", "popularity_score"]
TIES = "list_id, data_type, list_title"


def _rank_sql(key: str, keep: int, more: str = "") -> str:
    return with_catalog(f"SELECT {', '.join(RANKED)}{more} FROM (SELECT *, row_number() OVER (ORDER BY {key} DESC NULLS LAST, {TIES}) AS rank FROM rk) WHERE rank <= {keep}")


TREND = f"ln(1 + greatest(0, popularity_score)) / pow(greatest(1.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(updated_at, TIMESTAMP '{AS_OF}'))) / 3.6e9), 1.5)"


def _rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_rows(*Catalog(spark, sf_dir).all)


@query(_rank_sql(f"coalesce(updated_at, TIMESTAMP '{AS_OF}')", ranks.KEPT["latest"]))
def rank_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_latest(_rank_rows(spark, sf_dir), as_of()).select(RANKED)


@query(_rank_sql("popularity_score", ranks.KEPT["popular"]))
def rank_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_popular(_rank_rows(spark, sf_dir)).select(RANKED)


@query(_rank_sql(TREND, ranks.KEPT["trending"], f", round({TREND}, 9) AS trending_score"))
def rank_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_trending(_rank_rows(spark, sf_dir), as_of()).select(*RANKED, F.round("trending_score", 9).alias("trending_score"))


@query(_rank_sql(f"coalesce(updated_at, TIMESTAMP '{AS_OF}')", ranks.KEPT["latest"]).replace("FROM rk)", "FROM rk WHERE created_at IS NOT NULL)"))
def rank_latest_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with a date of creation, which does not count."""
    return ranks.rank_latest(_rank_rows(spark, sf_dir).where("created_at is not null"), as_of()).select(RANKED)


@query(_rank_sql(TREND, ranks.KEPT["trending"], f", round({TREND}, 9) AS trending_score").replace("FROM rk)", "FROM rk WHERE updated_at IS NULL)"))
def rank_trending_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that were never updated count as updated now, whenever they were created."""
    return ranks.rank_trending(_rank_rows(spark, sf_dir).where("updated_at is null"), as_of()).select(*RANKED, F.round("trending_score", 9).alias("trending_score"))


@query(with_catalog("SELECT count(DISTINCT nullif(list_id, 0)) AS total FROM rk"))
def metadata_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.metadata_total(ranks.rank_metadata(_rank_rows(spark, sf_dir), as_of()), "popular")


def _stored_popular(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ranking by popularity and the metadata of the rankings, written twice and read back."""
    folder, rows = stores.scratch(spark, "ranks"), _rank_rows(spark, sf_dir)
    for keep in (5, ranks.KEPT["popular"]):
        stores.replace_snapshot(ranks.rank_popular(rows, keep), f"{folder}/popular", order=("rank",))
    stores.replace_snapshot(ranks.rank_metadata(rows, as_of()), f"{folder}/metadata")
    return stores.read_snapshot(spark, f"{folder}/popular"), stores.read_snapshot(spark, f"{folder}/metadata")


_POPULAR = with_catalog(f"SELECT list_id, list_title, org_nm, token_count, has_generated_doc, data_type, (SELECT count(DISTINCT nullif(list_id, 0)) FROM rk) AS total FROM (SELECT *, row_number() OVER (ORDER BY popularity_score DESC, {TIES}) AS rank FROM rk) WHERE rank BETWEEN 41 AND 60")


def _ranked_or_live(spark: SparkSession, sf_dir: str, page: paging.Page) -> DataFrame:
    c = Catalog(spark, sf_dir)
    kept = listing.keep_first(listing.unified(*c.all))
    live = paging.take(kept, listing.by_sort("popular"), page), kept.agg(F.count("*").alias("total"))
    rows, total = ranks.ranked_or_live(*_stored_popular(spark, sf_dir), "popular", live, page)
    return rows.select("list_id", "list_title", "org_nm", "token_count", "has_generated_doc", "data_type").join(F.broadcast(total), F.lit(True))  # one row


@query(_POPULAR)
def page_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_or_live(spark, sf_dir, PAGE)


@query(with_catalog("SELECT list_id, list_title, org_nm, token_count, has_generated_doc, data_type, (SELECT count(DISTINCT nullif(list_id, 0)) FROM rk) AS total FROM kept ORDER BY popularity DESC, list_id LIMIT 100 OFFSET 1000"))
def page_beyond_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 11 of 100 rows is beyond the ranking's window: a live page, with the ranking's total."""
    return _ranked_or_live(spark, sf_dir, paging.clamp(11, 100))


@query(with_catalog("SELECT list_id, token_count, markdown FROM gapi WHERE list_id = (SELECT min(list_id) FROM gapi)"))
def lookup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    least = c.api_docs.agg(F.min("list_id")).first()[0]
    return lookup.point(c.api_docs, "list_id", least, ["token_count", "generated_at"]).select("list_id", "token_count", "markdown")


@query("SELECT event_id, CASE WHEN regexp_full_match(v, '[0-9]+') THEN v::BIGINT END AS id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || event_id WHEN event_id % 3 = 1 THEN event_id::VARCHAR ELSE '-' || event_id END AS v FROM events)")
def numeric_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN event_id % 3 = 0 THEN event_type || event_id WHEN event_id % 3 = 1 THEN cast(event_id AS string) ELSE '-' || event_id END")
    return table(spark, sf_dir, "events").select("event_id", ids_of_digits(text).alias("id"))


@query(with_catalog(f"""SELECT list_id, array_to_string(coalesce(keywords, []), '|') AS keywords, coalesce(org_nm, '') AS single, CASE WHEN list_id % 2 = 0 THEN {iso_sql('created_at')} END AS created, coalesce(TRY_CAST(substr(org_nm, 4) AS BIGINT), 0) AS number FROM api"""))
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of null and of one value, dates of ISO text and of none, numbers in text."""
    api = Catalog(spark, sf_dir).api
    when = F.when(F.col("list_id") % 2 == 0, iso(F.col("created_at"))).otherwise(F.lit("no date"))
    return api.select(
        "list_id",
        F.array_join(text_list(api, "keywords"), "|").alias("keywords"),
        F.array_join(text_list(api, "org_nm"), "|").alias("single"),
        iso(timestamp_or_null(when)).alias("created"),
        int_or_zero(F.substring("org_nm", 4, 9)).alias("number"),
    )


@query(with_catalog(f"""SELECT list_id, CASE WHEN list_id % 3 = 0 THEN 'FILE' ELSE 'API' END AS data_type, coalesce(token_count, 0) AS token_count, {iso_sql('generated_at')} AS generated_at, token_count IS NOT NULL AS has_generated_doc,
coalesce(request_cnt, 0) AS popularity_score, NULL::BIGINT AS rank FROM api LEFT JOIN gapi USING (list_id)"""))
def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an unknown kind count as API; counts are numbers, dates dates."""
    c = Catalog(spark, sf_dir)
    rows = c.api.join(c.api_docs.select("list_id", F.col("token_count").cast("string").alias("token_count"), F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at")), "list_id", "left")
    kind = F.expr("CASE list_id % 3 WHEN 0 THEN 'FILE' WHEN 1 THEN 'other' END")
    rows = rows.select("list_id", kind.alias("data_type"), "token_count", "generated_at", F.col("token_count").isNotNull().alias("has_generated_doc"), F.col("request_cnt").cast("string").alias("popularity_score"), F.lit(None).cast("string").alias("rank"))
    return ranks.coerced_items(rows).withColumn("generated_at", iso(F.col("generated_at")))


@query(f"SELECT event_id, round(ln(1 + greatest(0, value)) / pow(greatest(1.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9), 1.5), 9) AS score FROM events")
def trending_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.functions.coerce import trending_score

    return table(spark, sf_dir, "events").select("event_id", F.round(trending_score(F.col("value"), F.col("ts"), as_of()), 9).alias("score"))


@query(with_catalog("SELECT unnest(['latest', 'popular', 'trending']) AS sort_type, (SELECT count(DISTINCT nullif(list_id, 0)) FROM rk) AS total_count"))
def rank_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_metadata(_rank_rows(spark, sf_dir), as_of()).select("sort_type", "total_count")


@query(with_catalog("SELECT count(*) AS latest, count(*) AS popular, count(*) AS trending FROM rk"))
def rank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_counts(_rank_rows(spark, sf_dir))


@query(with_catalog(f"SELECT list_id, list_title, org_nm, token_count, has_generated_doc, data_type FROM (SELECT *, row_number() OVER (ORDER BY popularity_score DESC, {TIES}) AS rank FROM rk) WHERE rank BETWEEN 41 AND 60"))
def rank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.snapshot_page(ranks.rank_popular(_rank_rows(spark, sf_dir)), PAGE)


@query(with_catalog("SELECT count(DISTINCT nullif(list_id, 0)) AS total FROM rk"))
def distinct_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.distinct_listings(_rank_rows(spark, sf_dir))


@query(with_catalog("""SELECT a + f AS total_open_data, ga + gf AS total_generated_docs, a AS api_data_count, ga AS api_docs_count, f AS file_data_count, gf AS file_docs_count, round(ga / a * 100, 6) AS api_coverage, round(gf / f * 100, 6) AS file_coverage,
round((ga + gf) / (a + f) * 100, 6) AS total_coverage FROM (SELECT (SELECT count(*) FROM api) AS a, (SELECT count(*) FROM gapi) AS ga, (SELECT count(*) FROM file) AS f, (SELECT count(*) FROM gfile) AS gf)"""))
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage(*Catalog(spark, sf_dir).all).withColumns({k: F.round(k, 6) for k in ("api_coverage", "file_coverage", "total_coverage")})


@query("SELECT a AS total_open_data, g AS total_std_docs, round(g / a * 100, 2) AS success_rate FROM (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM labels) AS g)")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return stats.success_rate(c.api, c.api_docs)


@query(with_catalog("SELECT data_type, count(*) AS n FROM uni GROUP BY 1"))
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kind_counts(listing.unified(*Catalog(spark, sf_dir).all))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed FROM events")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outcome_counts(table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok")))


@query("SELECT count(*) AS documents, sum(length(text) + length(lang) + length(source))::BIGINT AS characters FROM documents")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_stats(table(spark, sf_dir, "documents"))
