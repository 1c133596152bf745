"""Corpus analytics on Spark: files and records in, clean searchable tables out."""
