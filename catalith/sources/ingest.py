"""Ingest jobs: listings to the text index, and to vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalith.operators.listing import search_documents
from catalith.operators.vectors import Encoder, embedding_text, encode
from catalith.sources.listings import recommendation_corpus
from catalith.sources.segments import upsert
from catalith.sources.stores import create_index, replace_snapshot


def index_listings(api: DataFrame, file: DataFrame, folder: str, recreate: bool = False) -> int:
    """Writes the search documents and their index under folder; returns how many documents.

    An index that is there stays, but for the documents given: the last one written under an id wins. One segment is written, in
    proportion to the documents given, and committed at once (see segments).
    """
    return upsert(search_documents(api, file), folder, recreate=recreate)


def embed_listings(api: DataFrame, file: DataFrame, encoder: Encoder, name: str, recreate: bool = True) -> int:
    """Writes a vector for each listing; returns how many."""
    create_index(encode(recommendation_corpus(api, file, api_first=True), encoder, embedding_text()), name, recreate)
    return api.sparkSession.table(name).count()


def build_rankings(rows: DataFrame, folder: str, as_of) -> dict[str, int]:  # noqa: ANN001
    """Rebuilds all rankings and their metadata under folder; returns the rows of each before it is cut."""
    from catalith.operators import ranks

    rows = rows.persist()
    made = {"latest": ranks.rank_latest(rows, as_of), "popular": ranks.rank_popular(rows), "trending": ranks.rank_trending(rows, as_of)}
    for name, df in made.items():
        replace_snapshot(df, f"{folder}/rank_{name}", order=("rank",))
    replace_snapshot(ranks.rank_metadata(rows, as_of), f"{folder}/rank_metadata")
    counts = ranks.rank_counts(rows).first().asDict()
    rows.unpersist()
    return counts
