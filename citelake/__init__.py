"""Bibliographic data quality on Spark DataFrames."""
