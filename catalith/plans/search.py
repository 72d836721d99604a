"""Queries of the text search, over titles of parts and over whole documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import stemming
from catalith.functions import text as analyzers
from catalith.functions.stemming import stems_sql
from catalith.operators import infix, listing, paging, search, search_pages, synonyms
from catalith.operators.listing import keep_first, unified
from catalith.plans.tables import CATALOG_SQL, Catalog, iso_sql, table
from catalith.sources.ingest import index_listings
from catalith.sources import segments
from catalith.sources.stores import fingerprint, work_folder

QUERIES, ORACLES = {}, {}
PARTS = {"list_id": "p_partkey", "list_title": "p_name", "title": "p_type", "org_nm": "p_brand", "desc": "p_type || ' ' || p_name"}
PARTS_SQL = "docs AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in PARTS.items()) + " FROM part)"
PART_FIELDS = {"list_title": "list_title", "title": "title", "title_alt": "title", "org_nm": "org_nm", "desc": "desc"}
#: Both kinds of listings under one id each, the FILE one where they share it.
LISTED_SQL = """lst AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY src DESC) AS r FROM (
SELECT list_id, list_title, title_en AS title, category_nm, dept_nm, org_nm, "desc", data_format, api_type, keywords, 'API' AS data_type, 0 AS src FROM api
UNION ALL SELECT list_id, list_title, title, new_category_nm, dept_nm, org_nm, "desc", data_type, 'FILE', keywords, 'FILE', 1 FROM file)) WHERE r = 1)"""
LISTED_FIELDS = {k: k for k in ("list_title", "title", "keywords", "org_nm", "category_nm", "dept_nm", "desc")} | {"title_alt": "title"}
_STOP = ", ".join(f"'{w}'" for w in analyzers.STOP_WORDS)
#: The tables that listings are made of.
LISTING_TABLES = ("documents", "pages")
_FOLDERS: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object], tables: tuple[str, ...]) -> str:
    """The folder of an index that build has written, once for each session and state of the tables' files."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *(fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in _FOLDERS:
        folder = f"{work_folder(spark)}/index-{name}-{uuid.uuid4().hex}"
        build(folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def _kind(field: str) -> str:
    return getattr(search.ANALYZERS.get(field), "__name__", "words")


def _terms(text: str, field: str) -> list[str]:
    """The terms of a request as SQL; its texts are words of a-z with spaces between."""
    words = text.lower().split()
    quoted = lambda ws: [f"'{w}'" for w in ws]
    if _kind(field) == "keyword":
        return quoted([text.strip()])
    if _kind(field) == "words":
        return quoted(words)
    return [f"({stems_sql(f'[{w}]')})[1]" for w in quoted(w for w in words if w not in analyzers.STOP_WORDS)]


def _analyzed_sql(field: str, column: str) -> str:
    if column == "keywords":
        return "list_filter(coalesce(keywords, []), lambda x: x <> '')"
    if _kind(field) == "keyword":
        return f"""CASE WHEN "{column}" <> '' THEN ["{column}"] ELSE [] END"""
    words = rf"""list_filter(string_split_regex(lower(coalesce("{column}", '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""
    return words if _kind(field) == "words" else stems_sql(f"list_filter({words}, lambda x: x NOT IN ({_STOP}))")


def hits_sql(source: str, fields: dict[str, str], clauses: list[search.Clause]) -> str:
    """Common table expressions up to hits(list_id, score), for clauses whose texts are words with spaces between."""
    value = lambda x: x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)
    rows, boosts = [], []
    for i, c in enumerate(clauses):
        for f, b in c.fields.items():
            terms = _terms(c.text, f)
            for j, t in enumerate(terms):
                edits = 0 if c.phrase else c.edits if c.edits is not None else f"(length({t}) > 2)::INT + (length({t}) > 5)::INT"
                rows.append((i, f"'{f}'", j, t, edits, len(terms), c.phrase, c.all_terms))
            boosts.append((i, f"'{f}'", float(b * c.boost)))
    values = lambda x: ", ".join(f"({', '.join(map(value, r))})" for r in x)
    ascii_ = r"regexp_replace(term, '[^\x00-\x7F]', '?', 'g')"  # a character is one edit; DuckDB counts bytes
    raw = " UNION ALL ".join(f"SELECT list_id, '{f}' AS field, {_analyzed_sql(f, c)} AS ts FROM {source}" for f, c in fields.items())
    return f"""q(clause, field, nth, asked, edits, terms, phrase, all_terms) AS (VALUES {values(rows)}),
bo(clause, field, boost) AS (VALUES {values(boosts)}),
raw AS (SELECT * FROM ({raw}) WHERE field IN (SELECT field FROM bo) AND len(ts) > 0),
tok AS (SELECT list_id, field, len(ts) AS len, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM raw),
st AS (SELECT field, count(*) AS docs, avg(len(ts)) AS mean_len FROM raw GROUP BY 1),
m AS (SELECT DISTINCT q.*, term FROM q JOIN (SELECT DISTINCT field, term FROM tok) v ON v.field = q.field AND (term = asked OR (edits > 0 AND levenshtein({ascii_}, asked) <= edits))),
tf AS (SELECT list_id, field, len, term, count(*) AS tf FROM tok WHERE (field, term) IN (SELECT (field, term) FROM m) GROUP BY ALL),
w AS (SELECT field, term, mean_len, ln(1 + (docs - n + 0.5) / (n + 0.5)) AS idf FROM (SELECT field, term, count(*) AS n FROM tf GROUP BY ALL) JOIN st USING (field)),
s1 AS (SELECT clause, list_id, field, nth, terms, all_terms, max(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))) AS w FROM tf JOIN w USING (field, term) JOIN m USING (field, term) WHERE NOT phrase GROUP BY ALL),
s2 AS (SELECT clause, list_id, field, sum(w) AS w FROM s1 GROUP BY clause, list_id, field, terms, all_terms HAVING NOT all_terms OR count(*) = terms),
p1 AS (SELECT clause, list_id, field, len, terms, pos - nth AS st, count(*) AS c FROM tok JOIN m USING (field, term) WHERE phrase GROUP BY ALL HAVING count(*) = terms),
p2 AS (SELECT clause, list_id, field, len, count(*) AS tf FROM p1 GROUP BY ALL),
pw AS (SELECT clause, field, mean_len, sum(idf) AS idf FROM m JOIN w USING (field, term) WHERE phrase GROUP BY ALL),
s3 AS (SELECT clause, list_id, field, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len)) AS w FROM p2 JOIN pw USING (clause, field)),
hits AS (SELECT list_id, sum(w) AS score FROM (SELECT clause, list_id, max(w * boost) AS w FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3) JOIN bo USING (clause, field) GROUP BY ALL) GROUP BY 1)"""


def _synonyms_sql(units: list[list[str]], fields: dict[str, float]) -> str:
    """The scores of units, each given as its readings, which are words with spaces between."""
    words = [(u, r, k, w, len(x.split())) for u, rs in enumerate(units) for r, x in enumerate(rs) for k, w in enumerate(x.split())]
    values = ", ".join(f"({u}, {r}, {k}, '{w}', {n})" for u, r, k, w, n in words)
    raw = " UNION ALL ".join(f"SELECT list_id, '{f}' AS field, {b} AS boost, {_analyzed_sql(f, PART_FIELDS[f])} AS ts FROM docs" for f, b in fields.items())
    return f"""WITH {PARTS_SQL},
q(unit, reading, nth, term, size) AS (VALUES {values}),
raw AS (SELECT * FROM ({raw}) WHERE len(ts) > 0),
tok AS (SELECT list_id, field, boost, len(ts) AS len, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM raw),
st AS (SELECT field, count(*) AS docs, avg(len(ts)) AS mean_len FROM raw GROUP BY 1),
p AS (SELECT unit, reading, list_id, field, boost, len, size, pos - nth AS st FROM tok JOIN q USING (term) GROUP BY ALL HAVING count(*) = size),
c AS (SELECT unit, list_id, field, boost, len, count(DISTINCT st) AS tf FROM p GROUP BY ALL),
w AS (SELECT unit, field, mean_len, ln(1 + (docs - n + 0.5) / (n + 0.5)) AS idf FROM (SELECT unit, field, count(*) AS n FROM c GROUP BY ALL) JOIN st USING (field)),
b AS (SELECT unit, list_id, max(boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))) AS w FROM c JOIN w USING (unit, field) GROUP BY ALL)
SELECT list_id, round(sum(w), 6) AS score FROM b GROUP BY 1"""


def _titles_sql(clauses: list[search.Clause]) -> str:
    return f"WITH {PARTS_SQL},\n{hits_sql('docs', PART_FIELDS, clauses)}\nSELECT list_id, round(score, 6) AS score FROM hits"


def _parts(spark: SparkSession, sf_dir: str) -> search.Index:
    docs = table(spark, sf_dir, "part").selectExpr(*(f"{v} AS {k}" for k, v in PARTS.items()))
    return segments.read_index(spark, stored(spark, sf_dir, "parts", lambda folder: segments.upsert(docs, folder, PART_FIELDS), ("part",)))


def _texts(spark: SparkSession, sf_dir: str) -> search.Index:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS list_id", "text")
    return segments.read_index(spark, stored(spark, sf_dir, "texts", lambda folder: segments.upsert(docs, folder, {"desc": "text"}), ("documents",)))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("list_id", F.round("score", 6).alias("score"))


def search_exact_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.search_titles(_parts(spark, sf_dir), " red widget ", exact=True))


def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.search_titles(_parts(spark, sf_dir), "rad widgot"))


def search_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.search_titles(_parts(spark, sf_dir), "small", min_score=30.0))


WEIGHTED = (["red widget", "smal ring", "brand", "economy"], [2.0, 1.5])


def search_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.search_weighted(_parts(spark, sf_dir), *WEIGHTED))


def search_adaptive_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.search_adaptive(_parts(spark, sf_dir), "small ring", 1))


def search_adaptive_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.search_adaptive(_parts(spark, sf_dir), "smal rings", 10))


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.bm25(_texts(spark, sf_dir), "the and aux", {"desc": 1.0}))


def search_phrase_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.clause_scores(_texts(spark, sf_dir), [search.Clause("the and", {"desc": 1.0}, phrase=True)]))


PART = "RIN.ex"


def search_infix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages that hold a part, from the postings of its rarest grams."""
    docs = table(spark, sf_dir, "pages").selectExpr("page_id AS list_id", "url AS text")
    folder = stored(spark, sf_dir, "grams", lambda folder: infix.write_gram_index(docs, folder), ("pages",))
    return infix.infix_search(infix.read_gram_index(spark, folder), PART)


TERMS = "the and"
TOP = [search.Clause("the mit license", {"desc": 1.0}), search.Clause("under the mit license", {"desc": 2.0}, phrase=True)]


def search_top_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 hits, from the ranges of ids that can hold one of them."""
    return _rounded(search.top_hits(_texts(spark, sf_dir), TOP, 20, 20))




def _listings_folder(spark: SparkSession, sf_dir: str) -> str:
    c = Catalog(spark, sf_dir, dated=False)
    return stored(spark, sf_dir, "listings", lambda folder: index_listings(c.api, c.file, folder), LISTING_TABLES)


def _listed(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame, search.Index]:
    c = Catalog(spark, sf_dir)
    folder = _listings_folder(spark, sf_dir)
    return c, segments.read_docs(spark, folder), segments.read_index(spark, folder)


def search_frontend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application's search: strict, or fuzzy where that finds less than a page; the second page of it."""
    c, docs, index = _listed(spark, sf_dir)
    hits = search.top(_rounded(search.search_adaptive(index, TERMS, 20)), 20, 20)
    return search_pages.found_listings(hits, docs, *c.all)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored index is made of: its segments, documents, tables, and whether each of them has bytes on disk."""
    folder = _listings_folder(spark, sf_dir)
    parts = segments.sizes(spark, folder).agg(F.max("segments").cast("long").alias("segments"), F.count("*").alias("parts"), F.min(F.col("bytes") > 0).alias("has_bytes"))
    return parts.join(segments.read_docs(spark, folder).agg(F.count("*").alias("documents")), F.lit(True))  # one row each


def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole keywords, letter for letter, beside the words of the other fields."""
    return _rounded(search.search_weighted(_listed(spark, sf_dir)[2], ["License", "Kind 3"], [1.0, 2.0]))


ENGLISH = "datas setting 12"


def search_english_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title's terms are stemmed, and so are the request's."""
    return _rounded(search.bm25(_listed(spark, sf_dir)[2], ENGLISH, {"title": 2.0}))


def search_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, docs, index = _listed(spark, sf_dir)
    return _rounded(search.search_titles(index, "example", data_type="FILE", docs=docs))


def search_or_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank request browses: the first page of the catalog."""
    c = Catalog(spark, sf_dir)
    page = paging.clamp(1, 20)
    found = search_pages.search_or_browse("  ", lambda q: search.search_adaptive(_listed(spark, sf_dir)[2], q, page.size), lambda: listing.live_page(unified(*c.all), "popular", page))
    return found.select("list_id", "list_title", "org_nm", "data_type")


INDEX_UPSERT_EXTRA = "the and license of the new one"
INDEX_UPSERT_TERMS = "the and license"


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run of the ingest: a changed listing and a new one replace and join what is there; the search finds what they say now."""
    c = Catalog(spark, sf_dir, dated=False)
    folder = f"{work_folder(spark)}/index-upsert-{uuid.uuid4().hex}"
    index_listings(c.api, c.file, folder)
    changed = c.api.where("list_id in (1, 2)").withColumn("desc", F.lit(INDEX_UPSERT_EXTRA))
    new = c.api.where("list_id = 3").withColumns({"list_id": F.lit(-5).cast("long"), "desc": F.lit(INDEX_UPSERT_EXTRA)})
    index_listings(changed.unionByName(new), c.file.limit(0), folder)
    hits = search.bm25(segments.read_index(spark, folder), INDEX_UPSERT_TERMS, {"desc": 1.0})
    kept = segments.read_docs(spark, folder).select("list_id", "data_type")
    return _rounded(hits).join(kept, "list_id").select("list_id", "data_type", "score")


def highlighted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", analyzers.highlight(F.col("p_name"), ["red", "ring"]).alias("title"))


def synonym_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = analyzers.with_synonyms(analyzers.words(F.col("p_name")), {"red": ["crimson", "scarlet"], "ring": ["loop"]})
    return table(spark, sf_dir, "part").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").cast("long").alias("n"))


SYNONYMS = [["red", "blue"], ["red widget", "hot plate"], ["widget", "gear"], ["gizmo", "cold anvil"]]
SYNONYM_FIELDS = {"list_title": 3.0, "desc": 1.0}
#: The units of two requests and what they stand for, written out for the SQL.
PHRASE_READINGS = [["red widget", "blue widget", "red gear", "blue gear", "hot plate"]]
UNIT_READINGS = [["gizmo", "cold anvil"], ["red", "blue"]]


def search_synonym_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase of two words in all its readings."""
    return _rounded(synonyms.synonym_scores(_parts(spark, sf_dir), "red widget", SYNONYM_FIELDS, SYNONYMS))


def search_synonym_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words, either of them or a synonym of it, one of which is of two words."""
    return _rounded(synonyms.synonym_scores(_parts(spark, sf_dir), "gizmo red", SYNONYM_FIELDS, SYNONYMS, phrase=False))


def search_with_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, docs, index = _listed(spark, sf_dir)
    hits = search.top_hits(index, search.weighted_clauses([TERMS]), search_pages.fetched(10))
    return search_pages.documented_page(_rounded(hits), docs, *c.all, page=2, size=10)


def search_by_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, index = _listed(spark, sf_dir)
    rows = search_pages.by_popularity(_rounded(search.bm25(index, TERMS, {"desc": 1.0})), keep_first(unified(*c.all)))
    return rows.select("list_id", "score", "popularity", "data_type").limit(30)


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total(search.bm25(_listed(spark, sf_dir)[2], TERMS, {"desc": 1.0}))


def char_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = table(spark, sf_dir, "part").select(F.explode(analyzers.char_grams(F.col("p_name"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").cast("long").alias("n"))


def english_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word is stemmed once, with how often it occurs."""
    words = table(spark, sf_dir, "documents").select(F.explode(analyzers.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    kept = words.where(~F.col("word").isin(analyzers.STOP_WORDS))
    return kept.groupBy(stemming.stem(F.col("word")).alias("term")).agg(F.sum("n").cast("long").alias("n"))


_WEIGHTED_TERMS = search.weighted_clauses([TERMS])
_LISTED_HITS = f"WITH {CATALOG_SQL},\n{LISTED_SQL},\n{hits_sql('lst', LISTED_FIELDS, _WEIGHTED_TERMS)}"
_DESC_HITS = f"WITH {CATALOG_SQL},\n{LISTED_SQL},\n{hits_sql('lst', LISTED_FIELDS, [search.Clause(TERMS, {'desc': 1.0})])}"
_TEXT = "docs AS (SELECT doc_id AS list_id, text FROM documents)"


def _listed_sql(clauses: list[search.Clause]) -> str:
    return f"WITH {CATALOG_SQL},\n{LISTED_SQL},\n{hits_sql('lst', LISTED_FIELDS, clauses)}\nSELECT list_id, round(score, 6) AS score FROM hits"


#: The strict hits if they fill a page of 20, else the fuzzy ones.
_ADAPTIVE_HITS = f"""WITH {CATALOG_SQL},
{LISTED_SQL},
strict_hits AS (WITH {hits_sql('lst', LISTED_FIELDS, search.strict_clauses(TERMS))} SELECT * FROM hits),
fuzzy_hits AS (WITH {hits_sql('lst', LISTED_FIELDS, search.fuzzy_clauses(TERMS))} SELECT * FROM hits),
hits AS (SELECT * FROM strict_hits WHERE (SELECT count(*) FROM strict_hits) >= 20 UNION ALL SELECT * FROM fuzzy_hits WHERE (SELECT count(*) FROM strict_hits) < 20)"""
ORACLES |= {
    "search_exact_phrase": _titles_sql(search.exact_clauses("red widget")),
    "search_fuzzy": _titles_sql(search.fuzzy_clauses("rad widgot")),
    "search_min_score": _titles_sql(search.fuzzy_clauses("small")) + " WHERE hits.score >= 30.0",
    "search_weighted": _titles_sql(search.weighted_clauses(*WEIGHTED)),
    "search_adaptive_strict": _titles_sql(search.strict_clauses("small ring")),
    "search_adaptive_relaxed": _titles_sql(search.fuzzy_clauses("smal rings")),
    "search_bm25": f"WITH {_TEXT},\n{hits_sql('docs', {'desc': 'text'}, [search.Clause('the and aux', {'desc': 1.0})])}\nSELECT list_id, round(score, 6) AS score FROM hits",
    "search_infix": f"SELECT page_id AS list_id, url AS text FROM pages WHERE contains(lower(url), lower('{PART}'))",
    "index_stats": f"""WITH {CATALOG_SQL},
{LISTED_SQL} SELECT 1::BIGINT AS segments, count(*) AS documents, (SELECT count(*) FROM (SELECT unnest([{", ".join(f"'{t}'" for t in segments.TABLES)}]))) AS parts, true AS has_bytes FROM lst""",
    "search_top_page": f"WITH {_TEXT},\n{hits_sql('docs', {'desc': 'text'}, TOP)}\nSELECT list_id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, list_id LIMIT 20 OFFSET 20",
    "search_phrase_text": f"WITH {_TEXT},\n{hits_sql('docs', {'desc': 'text'}, [search.Clause('the and', {'desc': 1.0}, phrase=True)])}\nSELECT list_id, round(score, 6) AS score FROM hits",
    "search_keywords": _listed_sql(search.weighted_clauses(["License", "Kind 3"], [1.0, 2.0])),
    "search_english_titles": _listed_sql([search.Clause(ENGLISH, {"title": 2.0})]),
    "search_by_kind": _listed_sql(search.fuzzy_clauses("example")) + " WHERE list_id IN (SELECT list_id FROM lst WHERE data_type = 'FILE')",
    "search_or_browse": f"WITH {CATALOG_SQL} SELECT list_id, list_title, org_nm, data_type FROM kept ORDER BY popularity DESC, list_id LIMIT 20",
    "index_upsert": f"""WITH {CATALOG_SQL},
{LISTED_SQL},
now AS (SELECT * REPLACE ('{INDEX_UPSERT_EXTRA}' AS "desc", 'API' AS data_type) FROM lst WHERE list_id IN (1, 2)
UNION ALL SELECT * REPLACE (-5 AS list_id, '{INDEX_UPSERT_EXTRA}' AS "desc", 'API' AS data_type) FROM lst WHERE list_id = 3 UNION ALL SELECT * FROM lst WHERE list_id NOT IN (1, 2)),
{hits_sql('now', LISTED_FIELDS, [search.Clause(INDEX_UPSERT_TERMS, {'desc': 1.0})])}
SELECT list_id, data_type, round(score, 6) AS score FROM hits JOIN now USING (list_id)""",
    "highlighted_titles": r"SELECT p_partkey, regexp_replace(p_name, '(?i)\b(red|ring)\b', '<em>\1</em>', 'g') AS title FROM part",
    "synonym_terms": r"""WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM part),
s(w, term) AS (VALUES ('red', 'crimson'), ('red', 'scarlet'), ('ring', 'loop'))
SELECT term, count(*) AS n FROM (SELECT w AS term FROM w UNION ALL SELECT term FROM w JOIN s USING (w)) GROUP BY 1""",
    "search_synonym_phrase": _synonyms_sql(PHRASE_READINGS, SYNONYM_FIELDS),
    "search_synonym_terms": _synonyms_sql(UNIT_READINGS, SYNONYM_FIELDS),
    "search_frontend": f"""{_ADAPTIVE_HITS},
top AS (SELECT list_id, round(score, 6) AS score FROM hits ORDER BY round(score, 6) DESC, list_id LIMIT 20 OFFSET 20)
SELECT t.list_id, CASE WHEN a.list_id IS NOT NULL THEN a.list_title ELSE f.list_title END AS list_title, CASE WHEN a.list_id IS NOT NULL THEN a.org_nm ELSE f.org_nm END AS org_nm,
coalesce(CASE WHEN a.list_id IS NOT NULL THEN ga.token_count ELSE gf.token_count END, 0) AS token_count, CASE WHEN a.list_id IS NOT NULL THEN ga.list_id ELSE gf.list_id END IS NOT NULL AS has_generated_doc,
{iso_sql("CASE WHEN a.list_id IS NOT NULL THEN ga.generated_at ELSE gf.generated_at END")} AS updated_at, CASE WHEN a.list_id IS NOT NULL THEN 'API' ELSE 'FILE' END AS data_type, t.score
FROM top t LEFT JOIN api a USING (list_id) LEFT JOIN file f USING (list_id) LEFT JOIN gapi ga USING (list_id) LEFT JOIN gfile gf USING (list_id)""",
    "search_with_docs": f"""{_LISTED_HITS},
t0 AS (SELECT list_id, round(score, 6) AS score FROM hits ORDER BY 2 DESC, 1 LIMIT 30),
t AS (SELECT * FROM (SELECT * FROM t0 WHERE list_id IN (SELECT list_id FROM gapi UNION SELECT list_id FROM gfile) ORDER BY score DESC, list_id LIMIT 20) ORDER BY score DESC, list_id LIMIT 10 OFFSET 10)
SELECT t.list_id, coalesce(nullif(CASE WHEN ga.list_id IS NOT NULL THEN a.list_title ELSE f.list_title END, ''), l.list_title, '') AS list_title, CASE WHEN ga.list_id IS NOT NULL THEN a.org_nm ELSE f.org_nm END AS org_nm,
coalesce(nullif(CASE WHEN ga.list_id IS NOT NULL THEN a.title ELSE f.title END, ''), l.title, '') AS title, t.score, CASE WHEN ga.list_id IS NOT NULL THEN 'API' ELSE 'FILE' END AS data_type
FROM t LEFT JOIN lst l USING (list_id) LEFT JOIN api a USING (list_id) LEFT JOIN file f USING (list_id) LEFT JOIN gapi ga USING (list_id)""",
    "search_by_popularity": f"{_DESC_HITS}\nSELECT list_id, round(score, 6) AS score, popularity, data_type FROM hits JOIN kept USING (list_id) ORDER BY popularity DESC, list_id LIMIT 30",
    "search_total": f"{_DESC_HITS}\nSELECT count(*) AS total FROM hits",
    "char_grams": r"""WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM part),
g AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w)
SELECT gram, count(*) AS n FROM (SELECT substr(w, i, 2) AS gram FROM g WHERE i + 1 <= length(w) UNION ALL SELECT substr(w, i, 3) FROM g WHERE i + 2 <= length(w)) GROUP BY 1""",
    "english_terms": rf"""WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents),
d AS (SELECT w, count(*) AS n FROM w WHERE w NOT IN ({_STOP}) GROUP BY 1)
SELECT ({stems_sql('[w]')})[1] AS term, sum(n)::BIGINT AS n FROM d GROUP BY 1""",
}
QUERIES |= {k: globals()[k] for k in ORACLES}
