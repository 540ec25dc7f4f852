"""Declarative routing and annotation of read fragments on Spark DataFrames."""
