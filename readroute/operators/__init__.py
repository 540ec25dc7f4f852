"""Operators over fragments: match, extract, route, assemble, aggregate."""
