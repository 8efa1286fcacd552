"""Readers (Parquet tables, fixture views, array files, logs) and writers."""
