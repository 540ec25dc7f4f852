"""Operators of a training-data pipeline: scoring, filters, de-duplication, tokens."""
