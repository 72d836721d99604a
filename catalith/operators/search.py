"""Weighted full-text search over an index of postings.

The index is five tables: postings (list_id, field, len, term, tf and at, the places of the term in the field, counted from 0; a row for each
term of a field of a document), terms (field, term and how many documents have it),
fields (how many documents have the field, and its mean length) and deletions (key, term): what is left of the first
PREFIX characters of a term after up to MAX_EDITS deletions. Two terms within as many edits share such a key: of an
alignment's first PREFIX characters on either side, no more than the edits are unmatched. So a fuzzy term reads its few keys
and verifies a handful of terms; no request reads the vocabulary. A stored index is sorted by term and key, and a request
reads what it asks for only: literals that go down to the scan while they are MAX_LITERALS at most, and
else the small side of a join. A fifth table, impacts, has for every field, term and range of RANGE_IDS ids the largest frequency and
the smallest length of the documents there; scores grow with the one and fall with the other, so these bound the score of every
document of a range, and a page of hits reads the ranges that can reach it (top_hits; the block-max form of WAND: Ding, Suel 2011). Every field has an analyzer, for texts and requests alike. Scores are BM25 (Robertson, Zaragoza 2009) within a
field, with idf = ln(1 + (N - n + 0.5) / (n + 0.5)) over the documents that have the field; a clause scores its
best field times its boost, and a document the sum of its clauses. A query term that matches several terms of the
vocabulary counts with the best of them. Distances of terms are Levenshtein's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import text as analyzers
from catalith.functions.coerce import strip

K1, B = 1.2, 0.75
#: Boosts of the fields by kind of clause.
EXACT = {"list_title": 3.0, "title": 2.0, "org_nm": 1.5}
FUZZY = {"list_title": 3.0, "title": 2.0, "title_alt": 2.0, "org_nm": 1.5, "dept_nm": 1.5, "desc": 0.8}
FUZZY_PHRASE = {"list_title": 4.0, "title": 3.0, "org_nm": 2.0}
WEIGHTED = {"list_title": 3.0, "title": 2.0, "title_alt": 2.0, "keywords": 2.0, "org_nm": 1.5, "category_nm": 1.5, "dept_nm": 1.5, "desc": 0.8}
STRICT = {"list_title": 3.0, "title": 2.0, "keywords": 2.0, "org_nm": 1.5}
FUZZY_PHRASE_BOOST, STRICT_PHRASE_BOOST = 4.0, 2.0

POSTINGS = "list_id long, field string, len int, term string, tf int, at array<int>"
Analyzer = Callable[[Column], Column]
#: Fields that are not read as words. The title is English, with its plain words in title_alt.
ANALYZERS: dict[str, Analyzer] = {"title": analyzers.english, **dict.fromkeys(("category_nm", "dept_nm", "keywords", "data_format", "api_type"), analyzers.keyword)}
#: Terms that a request puts into the scan of the index; with more, it joins them.
MAX_LITERALS = 5_000
#: Edits that deletions are stored for, and characters of a term that they are taken of: 37 keys for a term at most.
MAX_EDITS, PREFIX = 2, 8
#: Terms whose deletions one task makes: some two million rows.
TERMS_IN_TASK = 50_000
#: Terms of texts that are grouped at once in a task.
TERMS_AT_ONCE = 500_000
#: Ids of a range whose scores are bounded together; ranges that are read first, for the score that a page needs.
RANGE_IDS, FIRST_RANGES = 128, 4
#: What scores may be off by where ranges are left out; pages by scores of six decimals stay the same.
SLACK = 2e-6


@dataclass(frozen=True)
class Clause:
    """terms in fields (with a boost each); phrase: one after another; all_terms: each of them; edits: for each term, None by its length."""

    text: str
    fields: dict[str, float] = field(hash=False)
    phrase: bool = False
    all_terms: bool = False
    edits: int | None = 0
    boost: float = 1.0


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many elements of a column of arrays; a row is never cut."""
    held = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)) // most
    start = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if batch.num_rows else []
    for a, b in zip(start, [*start[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _grouped_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTINGS of rows (list_id, field, terms), a text's terms in their order: within the row, so that nothing is shuffled to group its terms."""
    for batch in batches:
        for part in _slices(batch, "terms", TERMS_AT_ONCE):
            n = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
            terms = part.column("terms").flatten().dictionary_encode()
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = row * len(terms.dictionary) + terms.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
            ends = np.append(first, len(key)).astype(np.int32)
            at = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order].astype(np.int32)))
            own = order[first]
            of_row = pa.array(row[own])
            cols = [part.column("list_id").take(of_row), part.column("field").take(of_row), pa.array(n[row[own]].astype(np.int32)), terms.dictionary.take(terms.indices.take(pa.array(own)))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(ends)), at], names=["list_id", "field", "len", "term", "tf", "at"])


def _run_impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest tf and the least len of each run of rows of one field, term and range."""
    for b in batches:
        if b.num_rows:
            new = np.append(True, np.zeros(b.num_rows - 1, bool))
            for c in ("field", "term", "range"):
                new[1:] |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            tf, length = (f.reduceat(b.column(c).to_numpy(), first) for f, c in ((np.maximum, "tf"), (np.minimum, "len")))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(first)) for c in ("field", "term", "range")), pa.array(tf), pa.array(length)], names=["field", "term", "range", "tf", "len"])


def term_counts(postings: DataFrame) -> DataFrame:
    """field, term and n, the documents that have it there."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("n"))


def field_totals(postings: DataFrame) -> DataFrame:
    """field, docs that have it and total, the tokens of all of them."""
    return postings.where(F.get("at", F.lit(0)) == 0).groupBy("field").agg(F.count("*").alias("docs"), F.sum("len").cast("long").alias("total"))


def mean_lengths(totals: DataFrame) -> DataFrame:
    return totals.select("field", "docs", (F.col("total") / F.col("docs")).alias("mean_len"))


def deletion_postings(terms: DataFrame, count: int | None = None) -> DataFrame:
    """key and term of each distinct term: its first PREFIX characters without those at i and j, of which none, one or two are places in it.

    A generator for each place keeps this in compiled code; a key that comes twice stays twice. count: how many terms there
    are where that is known; they are then dealt TERMS_IN_TASK to a task, as each becomes many rows there.
    """
    dealt = terms.select("term") if count is None else terms.select("term").repartition(max(1, math.ceil(count / TERMS_IN_TASK)), "term")
    heads = dealt.distinct().select("term", F.substring("term", 1, PREFIX).alias("head")).withColumn("n", F.length("head"))
    one = heads.select("term", "head", "n", F.explode(F.sequence(F.lit(0), "n")).alias("i")).where("i = 0 or i < n")
    two = one.select("term", "head", "i", F.explode(F.expr("sequence(if(i = 0, 0, i + 1), n)")).alias("j"))
    return two.select(F.expr("concat(substring(head, 1, i - 1), substring(head, i + 1, j - i - 1), substring(head, j + 1))").alias("key"), "term")


def term_impacts(postings: DataFrame) -> DataFrame:
    """field, term, range, tf and len: the most of a term and the least length in any document of a range."""
    return largest_impacts(postings.select("field", "term", range_of(F.col("list_id")).alias("range"), "tf", "len"))


def run_impacts(postings: DataFrame) -> DataFrame:
    """term_impacts() of each run of postings that stand together, without a shuffle; a key may come again, so readers take largest_impacts() of them."""
    rows = postings.select("field", "term", range_of(F.col("list_id")).alias("range"), "tf", "len")
    return rows.mapInArrow(_run_impacts, "field string, term string, range long, tf int, len int")


def range_of(list_id: Column) -> Column:
    return F.floor(list_id / RANGE_IDS).cast("long")


def largest_impacts(impacts: DataFrame) -> DataFrame:
    return impacts.groupBy("field", "term", "range").agg(F.max("tf").alias("tf"), F.min("len").alias("len"))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    deletions: DataFrame
    impacts: DataFrame
    analyzers: dict[str, Analyzer] = field(default_factory=lambda: ANALYZERS)

    @staticmethod
    def of(postings: DataFrame, by_field: dict[str, Analyzer] | None = None) -> Index:
        terms = term_counts(postings)
        return Index.stored(postings, terms, mean_lengths(field_totals(postings)), deletion_postings(terms), term_impacts(postings), by_field)

    @staticmethod
    def stored(postings: DataFrame, terms: DataFrame, fields: DataFrame, deletions: DataFrame, impacts: DataFrame, by_field: dict[str, Analyzer] | None = None) -> Index:
        return Index(postings, terms, fields, deletions, impacts, ANALYZERS if by_field is None else by_field)

    @property
    def tokens(self) -> DataFrame:
        """list_id, field, len, pos, term: a row for each token."""
        return self.postings.select("list_id", "field", "len", F.explode("at").alias("pos"), "term")

    def analyzer(self, name: str) -> Analyzer:
        return self.analyzers.get(name, analyzers.words)


def build_index(docs: DataFrame, fields: dict[str, str] | None = None, by_field: dict[str, Analyzer] | None = None) -> Index:
    """The index of docs. fields: the column of each field; by_field: the analyzers of fields that aren't words.

    docs have one row for each list_id. Arrays are read as their elements, one after the other. Null and empty texts have no tokens.
    """
    fields = fields or {k: k for k in (*WEIGHTED, *EXACT) if k in docs.columns} | ({"title_alt": "title"} if "title" in docs.columns else {})
    by_field = ANALYZERS if by_field is None else by_field
    kinds = dict(docs.dtypes)

    def terms(f: str, c: str):  # noqa: ANN202
        analyzer = by_field.get(f, analyzers.words)
        if kinds[c].startswith("array"):
            return F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(analyzer(x), F.array().cast("array<string>"))))
        return analyzer(F.col(c))

    each = [F.struct(F.lit(f).alias("field"), terms(f, c).alias("terms")) for f, c in fields.items()]
    rows = docs.where("list_id is not null").select(F.col("list_id").cast("long").alias("list_id"), F.explode(F.array(*each)).alias("x")).where(F.size("x.terms") > 0)
    return Index.of(rows.select("list_id", "x.field", "x.terms").mapInArrow(_grouped_terms, POSTINGS), by_field)


def query_terms(spark: SparkSession, asked: list[tuple[str, Analyzer]]) -> list[list[str]]:
    """The terms of each text of a request by its analyzer."""
    if not asked:
        return []
    cols = [F.coalesce(analyzer(strip(F.lit(text))), F.array().cast("array<string>")).alias(str(i)) for i, (text, analyzer) in enumerate(asked)]
    return [list(x) for x in spark.range(1).select(*cols).first()]  # the request's own texts


def near_terms(index: Index, asked: list[tuple[str, int]]) -> DataFrame:
    """(asked, edits, term) of all terms within the edits of those asked, which are the request's; met on what deletions leave of both."""
    if any(e > MAX_EDITS for _, e in asked):
        raise ValueError(f"edits are from 0 to {MAX_EDITS}")
    spark = index.postings.sparkSession
    keys = sorted({(a, e, k) for a, e in asked for k in analyzers.left_by_deletions(a[:PREFIX], e)})
    few = sorted({k for _, _, k in keys})
    rows = spark.createDataFrame(keys, "asked string, edits int, key string")
    postings = index.deletions.where(F.col("key").isin(few)) if len(few) <= MAX_LITERALS else index.deletions
    near = F.abs(F.length("term") - F.length("asked")) <= F.col("edits")
    met = postings.join(F.broadcast(rows) if len(few) <= MAX_LITERALS else rows, "key").where(near & F.expr("levenshtein(term, asked) <= edits"))
    return met.select("asked", "edits", "term").distinct()


def exact_sum(c: Column) -> Column:
    """The sum of scores in decimals, which is the same in any order of the rows: documents with the same scores tie, as they do in SQL."""
    return F.sum(c.cast("decimal(28,18)")).cast("double")


def _bm25(tf: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))


def _found_terms(index: Index, asked: list[tuple]) -> tuple[DataFrame, list[str] | None]:
    """(asked, edits, term) of the index's terms that the request's are or nearly are; the terms themselves while they are MAX_LITERALS at most."""
    spark = index.postings.sparkSession
    same = sorted({(x[3], x[4], x[3]) for x in asked})
    fuzzy = sorted({(x[3], x[4]) for x in asked if x[4]})
    rows = spark.createDataFrame(same, "asked string, edits int, term string")
    if not fuzzy:
        return rows, sorted({x[2] for x in same})
    near = near_terms(index, fuzzy)
    few = near.limit(MAX_LITERALS + 1).collect()
    if len(few) > MAX_LITERALS:
        return rows.unionByName(near).distinct(), None
    every = sorted({*same, *map(tuple, few)})
    return spark.createDataFrame(every, "asked string, edits int, term string"), sorted({x[2] for x in every})


@dataclass(frozen=True)
class _Request:
    """What clauses ask of an index: matches (clause, field, at, term, terms, phrase, all_terms), weight of the terms, boost of the clauses' fields."""

    matches: DataFrame
    weight: DataFrame
    boost: DataFrame
    only: Callable[[DataFrame], DataFrame]
    phrases: bool


def _request(index: Index, clauses: list[Clause]) -> _Request | None:
    """None for no clauses or texts without terms."""
    spark = index.postings.sparkSession
    pairs = [(i, c, f) for i, c in enumerate(clauses) for f in c.fields]
    analyzed = query_terms(spark, [(c.text, index.analyzer(f)) for _, c, f in pairs])
    asked, boosts = [], []
    for (i, c, f), ts in zip(pairs, analyzed, strict=True):
        for j, t in enumerate(ts):
            most = 0 if c.phrase else c.edits if c.edits is not None else (len(t) > 2) + (len(t) > 5)
            asked.append((i, f, j, t, int(most), len(ts), c.phrase, c.all_terms))
        boosts.append((i, f, float(c.fields[f] * c.boost)))
    if not asked:
        return None
    wanted = spark.createDataFrame(asked, "clause int, field string, at int, asked string, edits int, terms int, phrase boolean, all_terms boolean")
    boost = F.broadcast(spark.createDataFrame(boosts, "clause int, field string, boost double"))
    used = sorted({x[1] for x in asked})
    found, literals = _found_terms(index, asked)
    matches = wanted.join(found, ["asked", "edits"]).drop("asked", "edits").distinct()

    def only(df: DataFrame) -> DataFrame:
        df = df.where(F.col("field").isin(used))
        return df.where(F.col("term").isin(literals)) if literals is not None else df.join(found.select("term").distinct(), "term", "left_semi")

    matches = F.broadcast(matches) if literals is not None else matches  # MAX_LITERALS terms for each clause and field at most
    stats = F.broadcast(index.fields)  # a row for each field
    weight = only(index.terms).join(stats, "field").select("field", "term", "mean_len", F.log1p((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))
    return _Request(matches, F.broadcast(weight) if literals is not None else weight, boost, only, any(x[6] for x in asked))


def _term_scores(request: _Request, counted: DataFrame, key: str) -> DataFrame:
    """(clause, key, field, w) of clauses of terms: the best variant of each, their sum in a field; counted: key, field, term, tf, len."""
    single = counted.join(request.weight, ["field", "term"]).join(request.matches.where("not phrase"), ["field", "term"]).withColumn("w", _bm25(F.col("tf"), F.col("idf")))
    best = single.groupBy("clause", key, "field", "at", "terms", "all_terms").agg(F.max("w").alias("w"))
    summed = best.groupBy("clause", key, "field", "terms", "all_terms").agg(exact_sum(F.col("w")).alias("w"), F.count("*").alias("found"))
    return summed.where("not all_terms or found = terms").select("clause", key, "field", "w")


def _phrase_scores(request: _Request, whole: DataFrame, key: str) -> DataFrame:
    """The same of phrases; whole: clause, key, field, tf, len of the phrase."""
    phrase = request.matches.where("phrase").select("clause", "field", "term")
    idf = phrase.join(request.weight, ["field", "term"]).groupBy("clause", "field", "mean_len").agg(exact_sum(F.col("idf")).alias("idf"))
    return whole.join(idf, ["clause", "field"]).select("clause", key, "field", _bm25(F.col("tf"), F.col("idf")).alias("w"))


def _summed(request: _Request, scores: DataFrame, key: str) -> DataFrame:
    """(key, score): the best field of each clause times its boost, added up."""
    top = scores.join(request.boost, ["clause", "field"]).groupBy("clause", key).agg(F.max(F.col("w") * F.col("boost")).alias("w"))
    return top.groupBy(key).agg(exact_sum(F.col("w")).alias("score"))


def _scores(request: _Request, postings: DataFrame) -> DataFrame:
    hit = request.only(postings)
    scores = _term_scores(request, hit.select("list_id", "field", "len", "term", "tf"), "list_id")
    if request.phrases:  # occurrences whose terms agree on where the phrase begins
        phrase = request.matches.where("phrase").select("clause", "field", "at", "term", "terms")
        begun = F.explode(F.transform("at", lambda pos: pos - F.col("nth"))).alias("start")
        begins = hit.join(phrase.withColumnRenamed("at", "nth"), ["field", "term"]).select("clause", "list_id", "field", "len", "terms", begun)
        starts = begins.groupBy("clause", "list_id", "field", "len", "terms", "start").agg(F.count("*").alias("found"))
        whole = starts.where("found = terms").groupBy("clause", "list_id", "field", "len").agg(F.count("*").alias("tf"))
        scores = scores.unionByName(_phrase_scores(request, whole, "list_id"))
    return _summed(request, scores, "list_id")


def clause_scores(index: Index, clauses: list[Clause]) -> DataFrame:
    """(list_id, score) of every document that matches a clause; empty for no clauses or texts without terms."""
    request = _request(index, clauses)
    return index.postings.sparkSession.createDataFrame([], "list_id long, score double") if request is None else _scores(request, index.postings)


def range_bounds(request: _Request, impacts: DataFrame) -> DataFrame:
    """(range, score): no document of the range scores more. Ranges without a match have no row.

    A phrase is in a document no more often than the rarest of its terms.
    """
    known = request.only(impacts)
    scores = _term_scores(request, known, "range")
    if request.phrases:
        phrase = request.matches.where("phrase").select("clause", "field", "at", "term", "terms")
        least = known.join(phrase, ["field", "term"]).groupBy("clause", "range", "field", "terms").agg(F.min("tf").alias("tf"), F.min("len").alias("len"), F.count("*").alias("found"))
        scores = scores.unionByName(_phrase_scores(request, least.where("found = terms").select("clause", "range", "field", "tf", "len"), "range"))
    return _summed(request, scores, "range")


def _in_ranges(index: Index, ranges: list[int]) -> DataFrame:
    """The postings of ranges; neighbouring ones are one condition on the ids, which the scan gets."""
    runs: list[list[int]] = []
    for r in sorted(ranges):
        if runs and r == runs[-1][1] + 1:
            runs[-1][1] = r
        else:
            runs.append([r, r])
    if len(runs) > 64:  # many conditions cost more than they leave out
        return index.postings.where(F.col("list_id").between(runs[0][0] * RANGE_IDS, (runs[-1][1] + 1) * RANGE_IDS - 1)).where(range_of(F.col("list_id")).isin(ranges))
    which = F.lit(False)
    for a, b in runs:
        which = which | F.col("list_id").between(a * RANGE_IDS, (b + 1) * RANGE_IDS - 1)
    return index.postings.where(which)


def open_ranges(index: Index, clauses: list[Clause], wanted: int) -> tuple[_Request | None, list[int] | DataFrame, int]:
    """The request, the ranges that can hold one of its best wanted hits (a frame of them where they are more than MAX_LITERALS), and how many were read first.

    The ranges of the highest bounds are scored first; the score of their hit number wanted is one that every hit of the page has at least, so
    ranges whose bound is lower are left out.
    """
    request = _request(index, clauses)
    if request is None:
        return None, [], 0
    bounds = range_bounds(request, index.impacts)
    first = [r["range"] for r in bounds.orderBy(F.col("score").desc(), "range").limit(FIRST_RANGES + math.ceil(wanted / RANGE_IDS)).collect()]
    least = _scores(request, _in_ranges(index, first)).orderBy(F.col("score").desc()).select("score").limit(wanted).collect() if first else []
    if len(least) == wanted:
        bounds = bounds.where(F.col("score") >= least[-1]["score"] - SLACK)
    few = bounds.select("range").limit(MAX_LITERALS + 1).collect()
    return request, [r["range"] for r in few] if len(few) <= MAX_LITERALS else bounds.select("range"), len(first)


def top_hits(index: Index, clauses: list[Clause], size: int, offset: int = 0) -> DataFrame:
    """top() of clause_scores(), from the ranges of ids that can reach the page; ties and scores are the same."""
    request, ranges, _ = open_ranges(index, clauses, offset + size)
    if request is None:
        return top(clause_scores(index, []), size, offset)
    if isinstance(ranges, DataFrame):
        postings = index.postings.withColumn("range", range_of(F.col("list_id"))).join(ranges, "range", "left_semi").drop("range")
    else:
        postings = _in_ranges(index, ranges) if ranges else index.postings.where("false")
    return top(_scores(request, postings), size, offset)


def bm25(index: Index, text: str, fields: dict[str, float]) -> DataFrame:
    return clause_scores(index, [Clause(text, fields)])


def exact_clauses(text: str) -> list[Clause]:
    """A phrase in any of three fields, each a clause of its own."""
    return [Clause(text, {f: b}, phrase=True) for f, b in EXACT.items()]


def fuzzy_clauses(text: str) -> list[Clause]:
    """All terms within one edit in one field, or the phrase."""
    return [Clause(text, FUZZY, all_terms=True, edits=1), Clause(text, FUZZY_PHRASE, phrase=True, boost=FUZZY_PHRASE_BOOST)]


def strict_clauses(text: str) -> list[Clause]:
    return [Clause(text, EXACT, phrase=True, boost=STRICT_PHRASE_BOOST), Clause(text, STRICT, all_terms=True)]


def weighted_clauses(texts: list[str], weights: list[float] | None = None) -> list[Clause]:
    """A clause for each text, any of its terms with edits by length; missing weights are 1."""
    given = [*(weights or []), *[1.0] * len(texts)]
    return [Clause(t, WEIGHTED, edits=None, boost=w) for t, w in zip(texts, given, strict=False)]


def search_titles(index: Index, text: str, exact: bool = False, min_score: float | None = None, data_type: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Scores of an exact or fuzzy search; data_type keeps the documents of that kind (docs has it)."""
    found = clause_scores(index, exact_clauses(text) if exact else fuzzy_clauses(text))
    if data_type is not None:
        found = found.join(docs.where(F.col("data_type") == data_type).select("list_id"), "list_id", "left_semi")
    return found if min_score is None else found.where(F.col("score") >= min_score)


def search_weighted(index: Index, texts: list[str], weights: list[float] | None = None) -> DataFrame:
    return clause_scores(index, weighted_clauses(texts, weights))


def search_adaptive(index: Index, text: str, size: int) -> DataFrame:
    """The strict search if it finds size documents or more, else the fuzzy one."""
    strict = clause_scores(index, strict_clauses(text))
    return strict if strict.limit(size).count() >= size else clause_scores(index, fuzzy_clauses(text))


def top(hits: DataFrame, size: int, offset: int = 0) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), F.col("list_id").asc()).offset(offset).limit(size)


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").cast("long").alias("total"))
