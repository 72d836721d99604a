"""Stored tables: schemas and readers of listings, and the writers of rankings, requests, indexes and vectors."""
