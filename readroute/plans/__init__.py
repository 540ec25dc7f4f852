"""Specifications, their checks and the plans built from them."""
