"""Readers and writers of read files and tables of tags."""
