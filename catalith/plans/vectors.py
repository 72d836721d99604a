"""Queries of vectors and stored recommendations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import detail, recommendations, vector_index, vectors
from catalith.plans.tables import CATALOG_SQL, Catalog, as_of, table
from catalith.sources import stores
from catalith.sources.listings import recommendation_corpus
from catalith.sources.stores import valid_requests

TARGETS = ["0", "7", "100", "123", "499", "99999999"]
QUERIES, ORACLES = {}, {}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("label") % 2 == 0, "API").otherwise("FILE")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), kind.alias("doc_type"), F.col("embedding").alias("vector"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("similarity_score", F.round("similarity_score", 6))


def knn_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.neighbours_of(_vectors(spark, sf_dir), TARGETS, top_k=4, threshold=0.2))


def knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.all_neighbours(_vectors(spark, sf_dir), top_k=4, threshold=0.2))


def _index(spark: SparkSession, sf_dir: str, lists: Callable[[int], int]) -> vector_index.VectorIndex:
    rows = _vectors(spark, sf_dir)
    return vector_index.write_vector_index(rows, f"{stores.work_folder(spark)}/vector-index-{uuid.uuid4().hex}", lists(rows.count()))


def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, against all rows, from the lists that are probed."""
    index = _index(spark, sf_dir, vector_index.default_lists)
    asked = index.rows.where("cast(doc_id as long) % 50 = 0").select("doc_id", "v")
    return _rounded(vector_index.search(index, asked, top_k=10, threshold=0.0, probes=max(1, len(index.centres) * 3 // 4)))


def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_all from the blocks that the triangle inequality leaves open."""
    index = _index(spark, sf_dir, vector_index.exact_lists)
    return _rounded(vector_index.exact_neighbours(index, index.rows.select("doc_id", "v"), top_k=4, threshold=0.2))


def recommend_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir, dated=False)
    return _rounded(detail.enriched(_computed(spark, sf_dir), c.api, c.file))


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir, dated=False)
    return recommendation_corpus(c.api, c.file).select("doc_id", "doc_type", vectors.embedding_text().alias("content"))


def embedding_text_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short form: title, description and keywords."""
    c = Catalog(spark, sf_dir, dated=False)
    return recommendation_corpus(c.api, c.file, api_first=True).select("doc_id", "doc_type", vectors.embedding_text(with_office=False).alias("content"), "source")


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that writes of vectors report: inserted, replaced, one deleted, one that was not there, many asked for, and what is left."""
    path, rows = f"{stores.work_folder(spark)}/vectors-{uuid.uuid4().hex}", _vectors(spark, sf_dir)
    inserted = stores.upsert_snapshot(rows, path, "doc_id")
    replaced = stores.upsert_snapshot(rows.where("cast(doc_id as int) % 10 = 0").withColumn("doc_type", F.lit("API")), path, "doc_id")
    one, none = stores.remove_one(spark, path, "doc_id", "7"), stores.remove_one(spark, path, "doc_id", "-1")
    many = stores.remove_many(spark, path, "doc_id", ["8", "9", "-2"])
    left = stores.read_snapshot(spark, path).agg(F.count("*").cast("long").alias("left_rows"), F.count(F.when(F.col("doc_type") == "API", 1)).cast("long").alias("left_api"))
    return left.select(*(F.lit(v).cast("long").alias(k) for k, v in {"inserted": inserted, "replaced": replaced, "one": int(one), "none": int(none), "many": many}.items()), "left_rows", "left_api")


def failed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing as a target; those without a vector, or without a neighbour, have empty lists."""
    targets = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("target_doc_id"), F.lit("API").alias("target_doc_type"))
    return recommendations.failed(recommendations.gathered(targets, _computed(spark, sf_dir)))


def embed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing's vector by the encoder without a model, and what a reader checks of it: its size and its norm."""
    c = Catalog(spark, sf_dir, dated=False)
    made = vectors.encode(recommendation_corpus(c.api, c.file), vectors.hash_encoder(), vectors.embedding_text())
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return made.select("doc_id", "doc_type", F.size("vector").alias("size"), F.round(F.sqrt(square), 4).alias("norm"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("target_doc_id"), F.lit("API").alias("target_doc_type"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector has stored items: its four predecessors; every ninth an empty list."""
    v = F.col("vec_id")
    item = lambda i: F.struct((v - i).cast("string").alias("doc_id"), F.lit("API").alias("doc_type"), (F.lit(1.0) / i).alias("similarity_score"), i.cast("int").alias("rank"))
    items = F.when(v % 9 == 0, F.array().cast(f"array<{recommendations.ITEM}>")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(4)), item))
    at = F.expr("timestamp_ntz'2024-01-29 00:00:00' + make_dt_interval(0, cast(vec_id % 96 as int), 0, 0)")
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(v.cast("string").alias("target_doc_id"), F.lit("API").alias("target_doc_type"), items.alias("recommendations"))
    return rows.join(table(spark, sf_dir, "embeddings").select(v.cast("string").alias("target_doc_id"), at.alias("created_at"), at.alias("updated_at")), "target_doc_id").select(
        "*", F.lit(1).alias("version"), F.lit(None).cast("timestamp_ntz").alias("expires_at")
    )


def _computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.all_neighbours(_vectors(spark, sf_dir), top_k=4, threshold=0.2)


def rec_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = recommendations.gathered(_targets(spark, sf_dir).where("cast(target_doc_id as int) % 2 = 0"), _computed(spark, sf_dir))
    done = recommendations.upsert(_stored(spark, sf_dir), new, as_of())
    return done.select("target_doc_id", "version", F.size("recommendations").alias("n"), F.date_format("updated_at", "yyyy-MM-dd HH").alias("updated"), F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


def rec_cache_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what the store lacks is computed."""
    targets, kept = _targets(spark, sf_dir), _stored(spark, sf_dir)
    missing = recommendations.misses(targets, kept).select(F.col("target_doc_id").alias("doc_id"))
    made = vectors.all_neighbours(_vectors(spark, sf_dir), top_k=3, threshold=0.2, targets=missing)
    return _rounded(recommendations.cache_first(targets, kept, made, top_k=3))


def rec_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored recommendations deleted in their store: one target, one that is not there, several, then all; and what the store has on disk before that."""
    path, key = f"{stores.work_folder(spark)}/recommendations-{uuid.uuid4().hex}", "target_doc_id"
    stores.replace_snapshot(_stored(spark, sf_dir), path)
    one, none, many = stores.remove_one(spark, path, key, "9"), stores.remove_one(spark, path, key, "-1"), stores.remove_many(spark, path, key, ["0", "3", "-2"])
    has = stores.snapshot_stats(spark, path).first()
    cleared = stores.remove_all(spark, path)
    counts = {"one": int(one), "none": int(none), "many": many, "stored_rows": has["rows"], "has_bytes": int(has["bytes"] > 0), "versions": has["versions"], "cleared": cleared}
    left = stores.read_snapshot(spark, path).agg(F.count("*").alias("left_rows"))
    return left.select(*(F.lit(v).cast("long").alias(k) for k, v in counts.items()), "left_rows")


def rec_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommendations.cached(_stored(spark, sf_dir), 2))


def rec_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("target_doc_id"))
    done = recommendations.cache_stats(_stored(spark, sf_dir), asked, as_of())
    return done.withColumn("avg_recommendations_per_doc", F.round("avg_recommendations_per_doc", 6))


def save_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS list_id", "CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN props END AS url", "ts")
    return valid_requests(rows, F.col("ts")).select("list_id", "url", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


_UNIT = "v AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'API' ELSE 'FILE' END AS doc_type, embedding::DOUBLE[] AS e FROM embeddings)"
_PAIRS = f"""{_UNIT}, p AS (SELECT t.vec_id AS a, c.vec_id AS b, c.doc_type, list_cosine_similarity(t.e, c.e) AS s FROM v t, v c WHERE t.vec_id <> c.vec_id),
k AS (SELECT a::VARCHAR AS target_doc_id, b::VARCHAR AS doc_id, doc_type, round(s, 6) AS similarity_score, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM p WHERE s >= 0.2)"""
_KNN = f"WITH {_PAIRS} SELECT * FROM k WHERE rank <= 4"
_IN = ", ".join(f"'{t}'" for t in TARGETS)
_STORED = """st AS (SELECT vec_id, TIMESTAMP '2024-01-29 00:00:00' + (vec_id % 96) * INTERVAL 1 HOUR AS made, vec_id % 9 <> 0 AS has FROM embeddings WHERE vec_id % 3 = 0)"""
_ITEMS = """SELECT vec_id::VARCHAR AS target_doc_id, (vec_id - i)::VARCHAR AS doc_id, 'API' AS doc_type, round(1.0 / i, 6)::DOUBLE AS similarity_score, i AS rank{} FROM st, range(1, 5) AS r(i) WHERE has AND i <= {}"""
ORACLES |= {
    "knn_one": f"{_KNN} AND target_doc_id IN ({_IN})",
    "knn_all": _KNN,
    "knn_pruned": _KNN,
    "recommend_enriched": f"""WITH {CATALOG_SQL}, {_PAIRS}, known AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY src) AS r FROM (
SELECT list_id, list_title, org_nm, 'API' AS data_type, 0 AS src FROM api UNION ALL SELECT list_id, coalesce(nullif(list_title, ''), title), org_nm, 'FILE', 1 FROM file))
SELECT target_doc_id, k.rank, list_id, list_title, org_nm, data_type, similarity_score FROM k JOIN known ON list_id = doc_id::BIGINT AND r = 1 WHERE rank <= 4""",
    "embedding_text": f"""WITH {CATALOG_SQL} SELECT list_id::VARCHAR AS doc_id, 'API' AS doc_type, coalesce(list_title, '') || '. ' || coalesce("desc", '') || '. 핵심키워드: ' || array_to_string(coalesce(keywords, []), ' ') || '. 기관: ' || coalesce(org_nm, '') || '. 카테고리: ' || coalesce(new_category_nm, '') AS content FROM api
UNION ALL SELECT list_id::VARCHAR, 'FILE', coalesce(nullif(list_title, ''), title) || '. ' || coalesce("desc", '') || '. 핵심키워드: ' || array_to_string(coalesce(keywords, []), ' ') || '. 기관: ' || coalesce(org_nm, '') || '. 카테고리: ' || coalesce(new_category_nm, '') FROM file""",
    "embedding_text_short": f"""WITH {CATALOG_SQL} SELECT list_id::VARCHAR AS doc_id, 'API' AS doc_type, coalesce(list_title, '') || '. ' || coalesce("desc", '') || '. 핵심키워드: ' || array_to_string(coalesce(keywords, []), ' ') AS content, 0 AS source FROM api
UNION ALL SELECT list_id::VARCHAR, 'FILE', coalesce(nullif(list_title, ''), title) || '. ' || coalesce("desc", '') || '. 핵심키워드: ' || array_to_string(coalesce(keywords, []), ' '), 1 FROM file""",
    "vector_store": f"""WITH {_UNIT}, w AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'API' ELSE doc_type END AS doc_type FROM v WHERE vec_id NOT IN (7, 8, 9))
SELECT (SELECT count(*) FROM v) AS inserted, (SELECT count(*) FROM v WHERE vec_id % 10 = 0) AS replaced, (SELECT count(*) FROM v WHERE vec_id = 7) AS one, 0::BIGINT AS none, 3::BIGINT AS many,
(SELECT count(*) FROM w) AS left_rows, (SELECT count(*) FROM w WHERE doc_type = 'API') AS left_api""",
    "failed_targets": f"WITH {_PAIRS} SELECT count(*) AS failed FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT target_doc_id FROM k)",
    "rec_upsert": f"""WITH {_PAIRS}, {_STORED}, n AS (SELECT vec_id, (SELECT count(*) FROM k WHERE rank <= 4 AND target_doc_id = vec_id::VARCHAR) AS n FROM embeddings WHERE vec_id % 2 = 0)
SELECT coalesce(n.vec_id, st.vec_id)::VARCHAR AS target_doc_id, CASE WHEN n.vec_id IS NULL OR st.vec_id IS NULL THEN 1 ELSE 2 END AS version, coalesce(n.n, CASE WHEN has THEN 4 ELSE 0 END) AS n,
CASE WHEN n.vec_id IS NOT NULL THEN '2024-02-01 00' ELSE strftime(made, '%Y-%m-%d %H') END AS updated, CASE WHEN n.vec_id IS NOT NULL THEN '2024-02-08' END AS expires FROM n FULL JOIN st ON n.vec_id = st.vec_id""",
    "rec_cache_first": f"""WITH {_PAIRS}, {_STORED} {_ITEMS.format(", 'cache' AS source", 3)}
UNION ALL SELECT *, 'realtime' FROM k WHERE rank <= 3 AND target_doc_id NOT IN (SELECT vec_id::VARCHAR FROM st WHERE has)""",
    "rec_delete": f"""WITH {_STORED} SELECT count(*) FILTER (vec_id = 9) AS one, 0::BIGINT AS none, 3::BIGINT AS many, count(*) FILTER (vec_id NOT IN (0, 3, 9)) AS stored_rows,
1::BIGINT AS has_bytes, 2::BIGINT AS versions, count(*) FILTER (vec_id NOT IN (0, 3, 9)) AS cleared, 0::BIGINT AS left_rows FROM st""",
    "rec_cached": f"WITH {_STORED} {_ITEMS.format('', 2)}",
    "rec_cache_stats": f"""WITH {_STORED} SELECT count(*) AS total_cached_docs, count(*) FILTER (made >= TIMESTAMP '2024-01-31 00:00:00') AS recent_recommendations, round(avg(CASE WHEN has THEN 4.0 ELSE 0.0 END), 6) AS avg_recommendations_per_doc,
(SELECT printf('%.2f%%', 100.0 * count(*) FILTER (user_id IN (SELECT vec_id FROM st WHERE has)) / count(*)) FROM events) AS cache_hit_ratio FROM st""",
    "save_request": """SELECT user_id AS list_id, CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN props END AS url, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS created_at FROM events WHERE user_id <> 0 OR event_type = 'click'""",
}
QUERIES |= {k: globals()[k] for k in [*ORACLES, "embed_listings", "knn_index"]}
