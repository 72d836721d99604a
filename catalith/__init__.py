"""Catalog analytics on Spark: relational, text-search and vector operators as DataFrame plans."""
