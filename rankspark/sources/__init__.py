"""Readers: files, tables and landing directories. All go through Spark's own readers."""
