"""How the test tables play the catalog's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
TITLE = "CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '' ELSE url END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


class Catalog:
    """documents as API listings, pages as FILE listings, labels and some pages as their generated documents.

    What the test tables lack is made up from the ids: null and empty texts, missing dates, keywords. dated: with updated_at, by the key of
    orders; readers of texts alone go without, as whole texts would be shuffled for it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, dated: bool = True) -> None:
        documents, pages, labels, orders = (table(spark, sf_dir, k) for k in ("documents", "pages", "labels", "orders"))
        dates = orders.selectExpr("o_orderkey AS list_id", "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS updated_at")
        minute = lambda k: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {k}, 0)")
        with_dates = lambda rows: rows.join(dates, "list_id", "left") if dated else rows
        created = F.expr("CASE WHEN list_id % 5 <> 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(list_id % 40 as int)) END")
        self.api = with_dates(documents.selectExpr(
            "doc_id AS list_id", "split_part(text, chr(10), 1) AS list_title", "CAST(NULL AS string) AS title", "CASE WHEN doc_id % 4 = 0 THEN 'data_set ' || doc_id END AS title_en", "text AS desc",
            "source AS org_nm", "CASE WHEN doc_id % 3 <> 0 THEN 'office ' || lang END AS dept_nm", "lang AS category_nm", "'new ' || lang AS new_category_nm",
            "CASE WHEN doc_id % 2 = 0 THEN 'JSON' ELSE 'XML' END AS data_format", "CASE WHEN doc_id % 3 = 0 THEN 'REST' END AS api_type", "'free' AS is_charged", "CASE WHEN doc_id % 2 = 0 THEN 'yes' END AS is_copyrighted",
            "'no' AS is_third_party_copyrighted", "CASE WHEN doc_id % 7 <> 0 THEN 'listed' END AS register_status", "'open' AS use_prmisn_ennc",
            "CASE WHEN doc_id % 6 <> 0 THEN array(lang, 'License', 'Kind ' || doc_id % 7) END AS keywords", "n_chars AS request_cnt",
        )).withColumn("created_at", created)
        self.file = with_dates(pages.selectExpr(
            "page_id * 7 AS list_id", f"{TITLE} AS list_title", "url AS title", "CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'Office' END AS org_nm", "'web' AS dept_nm",
            "CASE WHEN page_id % 4 <> 0 THEN 'web ' || page_id % 3 END AS new_category_nm", "CASE WHEN page_id % 2 = 0 THEN 'CSV' END AS data_type", "'paid' AS is_charged", "CAST(NULL AS string) AS is_copyrighted",
            "CASE WHEN page_id % 3 = 0 THEN 'yes' END AS is_third_party_copyrighted", "CAST(NULL AS string) AS register_status", "CASE WHEN page_id % 3 = 1 THEN 'owned' END AS ownership_grounds",
            "CASE WHEN page_id % 3 = 2 THEN array('Web', 'Page') END AS keywords", "CASE WHEN page_id % 13 <> 0 THEN CAST(length(html) AS bigint) END AS download_cnt", "'' AS desc",
        )).withColumn("created_at", created)
        self.api_docs = labels.selectExpr("doc_id AS list_id", "CAST(quality * 100 + toxic + 10 AS bigint) AS token_count").withColumn("generated_at", minute("list_id")).withColumn("markdown", F.concat(F.lit("# "), F.col("list_id")))
        self.file_docs = pages.where("page_id % 4 = 0").selectExpr("page_id * 7 AS list_id", "CAST(length(url) AS bigint) AS token_count").withColumn("generated_at", minute("list_id")).withColumn("markdown", F.lit("file"))

    @property
    def all(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return self.api, self.file, self.api_docs, self.file_docs


CATALOG_SQL = f"""
dated AS (SELECT o_orderkey AS list_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS updated_at FROM orders),
api AS (SELECT *, CASE WHEN list_id % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + (list_id % 40) * INTERVAL 1 DAY END AS created_at FROM (
        SELECT doc_id AS list_id, split_part(text, chr(10), 1) AS list_title, NULL::VARCHAR AS title, CASE WHEN doc_id % 4 = 0 THEN 'data_set ' || doc_id END AS title_en, text AS "desc",
        source AS org_nm, CASE WHEN doc_id % 3 <> 0 THEN 'office ' || lang END AS dept_nm, lang AS category_nm, 'new ' || lang AS new_category_nm,
        CASE WHEN doc_id % 2 = 0 THEN 'JSON' ELSE 'XML' END AS data_format, CASE WHEN doc_id % 3 = 0 THEN 'REST' END AS api_type, 'free' AS is_charged, CASE WHEN doc_id % 2 = 0 THEN 'yes' END AS is_copyrighted,
        'no' AS is_third_party_copyrighted, CASE WHEN doc_id % 7 <> 0 THEN 'listed' END AS register_status, 'open' AS use_prmisn_ennc,
        CASE WHEN doc_id % 6 <> 0 THEN [lang, 'License', 'Kind ' || doc_id % 7] END AS keywords, n_chars AS request_cnt FROM documents) LEFT JOIN dated USING (list_id)),
file AS (SELECT *, CASE WHEN list_id % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + (list_id % 40) * INTERVAL 1 DAY END AS created_at FROM (
        SELECT page_id * 7 AS list_id, {TITLE} AS list_title, url AS title, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'Office' END AS org_nm, 'web' AS dept_nm,
        CASE WHEN page_id % 4 <> 0 THEN 'web ' || page_id % 3 END AS new_category_nm, CASE WHEN page_id % 2 = 0 THEN 'CSV' END AS data_type, 'paid' AS is_charged, NULL::VARCHAR AS is_copyrighted,
        CASE WHEN page_id % 3 = 0 THEN 'yes' END AS is_third_party_copyrighted, NULL::VARCHAR AS register_status, CASE WHEN page_id % 3 = 1 THEN 'owned' END AS ownership_grounds,
        CASE WHEN page_id % 3 = 2 THEN ['Web', 'Page'] END AS keywords, CASE WHEN page_id % 13 <> 0 THEN length(html)::BIGINT END AS download_cnt, '' AS "desc" FROM pages) LEFT JOIN dated USING (list_id)),
gapi AS (SELECT doc_id AS list_id, (quality * 100 + toxic + 10)::BIGINT AS token_count, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS generated_at, '# ' || doc_id AS markdown FROM labels),
gfile AS (SELECT page_id * 7 AS list_id, length(url)::BIGINT AS token_count, TIMESTAMP '2024-01-01 00:00:00' + page_id * 7 * INTERVAL 1 MINUTE AS generated_at, 'file' AS markdown FROM pages WHERE page_id % 4 = 0),
uni AS (SELECT list_id, list_title, org_nm, coalesce(request_cnt, 0) AS popularity, updated_at, coalesce(token_count, 0) AS token_count, token_count IS NOT NULL AS has_generated_doc, generated_at, 'API' AS data_type, 0 AS src
        FROM api LEFT JOIN gapi USING (list_id)
        UNION ALL SELECT list_id, coalesce(list_title, title), coalesce(org_nm, dept_nm), coalesce(download_cnt, 0), updated_at, coalesce(token_count, 0), token_count IS NOT NULL, generated_at, 'FILE', 1
        FROM file LEFT JOIN gfile USING (list_id)),
kept AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY src) AS r FROM uni) WHERE r = 1),
rk AS (SELECT list_id, 'API' AS data_type, list_title, org_nm, coalesce(token_count, 0) AS token_count, token_count IS NOT NULL AS has_generated_doc, created_at, updated_at, request_cnt::DOUBLE AS popularity_score FROM api LEFT JOIN gapi USING (list_id)
       UNION ALL SELECT list_id, 'FILE', coalesce(nullif(list_title, ''), title), coalesce(nullif(org_nm, ''), dept_nm), coalesce(token_count, 0), token_count IS NOT NULL, created_at, updated_at, coalesce(download_cnt, 0)::DOUBLE FROM file LEFT JOIN gfile USING (list_id))"""


def iso_sql(c: str) -> str:
    return f"CASE WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
