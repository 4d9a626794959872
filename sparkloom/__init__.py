"""Spark-first analytics over source trees, tables and text corpora."""
