"""Catalogue panel analytics on Spark: parsing, panel history, category reports."""
