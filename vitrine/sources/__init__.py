"""Readers of tables, query results and CSV exports."""
