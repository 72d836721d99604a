"""Operators over DataFrames: lookups, listings, rankings, search, vectors, cached recommendations."""
