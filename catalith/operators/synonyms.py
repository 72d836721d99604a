"""Search with synonyms of one or more words, over the postings of an index.

The request becomes a token graph: its words are edges from node to node, and where a phrase of a group stands, every other phrase
of the group is a path beside it, with nodes of its own. A phrase is in a text where a path from the first node to the last
stands there word after word, so synonyms of several words neither shift what follows nor cost a search for each combination: each
edge is met once, on the places that the postings hold. The index keeps the places of the text itself, and a changed rule asks for
no new index. Groups are analysed as the field is; a synonym's own words are not replaced again.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators import search


@dataclass(frozen=True)
class TokenGraph:
    """Edges (from, to, term) between nodes 0 to end, numbered so that every edge ascends."""

    edges: tuple[tuple[int, int, str], ...]
    end: int


def _beside(terms: list[str], groups: list[list[tuple[str, ...]]]) -> set[tuple[int, int, tuple[str, ...]]]:
    """(from, to, phrase): the other phrases of a group wherever one of its phrases stands in terms."""
    out = set()
    for group in groups:
        for p in set(group):
            for i in range(len(terms) - len(p) + 1):
                if p and tuple(terms[i : i + len(p)]) == p:
                    out |= {(i, i + len(p), q) for q in group if q and q != p}
    return out


def token_graph(terms: list[str], groups: list[list[tuple[str, ...]]]) -> TokenGraph:
    """The graph of a request's terms; phrases are tuples of terms, empty ones are ignored."""
    edges = [((Fraction(i), 0), (Fraction(i + 1), 0), t) for i, t in enumerate(terms)]
    for path, (i, j, phrase) in enumerate(sorted(_beside(terms, groups)), 1):
        inner = [(i + Fraction((j - i) * s, len(phrase)), path) for s in range(1, len(phrase))]
        nodes = [(Fraction(i), 0), *inner, (Fraction(j), 0)]
        edges += zip(nodes, nodes[1:], phrase, strict=False)
    number = {n: k for k, n in enumerate(sorted({n for a, b, _ in edges for n in (a, b)}))}
    return TokenGraph(tuple(sorted({(number[a], number[b], t) for a, b, t in edges})), len(number) - 1)


def units(terms: list[str], groups: list[list[tuple[str, ...]]]) -> list[list[str]]:
    """terms cut from left to right into the longest phrases of groups and single words."""
    known = {p for g in groups for p in g if p}
    longest, out, i = max(map(len, known), default=1), [], 0
    while i < len(terms):
        n = next((n for n in range(longest, 1, -1) if i + n <= len(terms) and tuple(terms[i : i + n]) in known), 1)
        out.append(terms[i : i + n])
        i += n
    return out


def _with_starts(rows: DataFrame, name: str, graph: TokenGraph, places: Column) -> DataFrame:
    """A column name0 of the places where a path of the graph begins, node by node from the last; places maps terms to places."""

    def ways(a: int, b: int, term: str) -> Column:
        at = F.coalesce(F.try_element_at(places, F.lit(term)), F.array().cast("array<int>"))
        return at if b == graph.end else F.array_intersect(at, F.transform(f"{name}{b}", lambda p: p - 1))

    for node in reversed(range(graph.end)):
        rows = rows.withColumn(f"{name}{node}", reduce(F.array_union, [ways(*e) for e in graph.edges if e[0] == node]))
    return rows


def matched(index: search.Index, text: str, fields: list[str], groups: list[list[str]], phrase: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """(unit, list_id, field, len, tf) of every document in which a unit of the request has a reading, tf the places where one begins; and the units by field.

    As a phrase the request is one unit; else units() cuts it. A text without terms in a field has no unit there.
    """
    spark = index.postings.sparkSession
    asked = [(t, index.analyzer(f)) for f in fields for t in (text, *(p for g in groups for p in g))]
    analysed = iter(search.query_terms(spark, asked))
    graphs: list[tuple[int, str, TokenGraph]] = []
    for f in fields:
        terms = next(analysed)
        rules = [[tuple(next(analysed)) for _ in g] for g in groups]
        graphs += [(i, f, token_graph(u, rules)) for i, u in enumerate([terms] * bool(terms) if phrase else units(terms, rules))]
    wanted = sorted({t for _, _, g in graphs for _, _, t in g.edges})
    hit = index.postings.where(F.col("field").isin([f for _, f, _ in graphs]) if graphs else F.lit(False))
    if len(wanted) <= search.MAX_LITERALS:
        hit = hit.where(F.col("term").isin(wanted))
    else:
        hit = hit.join(spark.createDataFrame([(t,) for t in wanted], "term string"), "term", "left_semi")
    found = hit.groupBy("list_id", "field", "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("_places"))
    counts = []
    for k, (unit, f, graph) in enumerate(graphs):
        here = F.when(F.col("field") == f, F.col("_places")).otherwise(F.create_map().cast("map<string,array<int>>"))
        found = _with_starts(found.withColumn(f"_places{k}", here), f"_at{k}_", graph, F.col(f"_places{k}"))
        counts.append(F.struct(F.lit(unit).alias("unit"), F.size(f"_at{k}_0").alias("tf")))
    none = F.array().cast("array<struct<unit:int,tf:int>>")
    met = found.select("list_id", "field", "len", F.inline(F.filter(F.array(*counts) if counts else none, lambda x: x["tf"] > 0)))
    return met.select("unit", "list_id", "field", "len", "tf"), {f: sum(g == f for _, g, _ in graphs) for f in fields}


def synonym_scores(index: search.Index, text: str, fields: dict[str, float], groups: list[list[str]], phrase: bool = True, all_units: bool = False) -> DataFrame:
    """(list_id, score): each unit counts as one term with BM25, by the documents that have any reading of it; the best field of each times its boost, added up.

    all_units keeps, in a field, the documents that have every unit there.
    """
    met, many = matched(index, text, list(fields), groups, phrase)
    if all_units:
        size = reduce(lambda c, f: c.when(F.col("field") == f, F.lit(many[f])), fields, F.when(F.lit(False), F.lit(0)))
        full = met.groupBy("list_id", "field").agg(F.count("*").alias("n")).where(F.col("n") == size).select("list_id", "field")
        kept = met.join(full, ["list_id", "field"], "left_semi")
    else:
        kept = met
    idf = met.groupBy("unit", "field").agg(F.count("*").alias("n")).join(F.broadcast(index.fields), "field")  # a row for each unit and field
    weight = idf.select("unit", "field", "mean_len", F.log1p((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))
    boost = reduce(lambda c, f: c.when(F.col("field") == f, F.lit(float(fields[f]))), fields, F.when(F.lit(False), F.lit(0.0)))
    scored = kept.join(F.broadcast(weight), ["unit", "field"]).withColumn("w", search._bm25(F.col("tf"), F.col("idf")) * boost)
    return scored.groupBy("list_id", "unit").agg(F.max("w").alias("w")).groupBy("list_id").agg(search.exact_sum(F.col("w")).alias("score"))
