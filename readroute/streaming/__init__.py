"""Routing of fragment streams."""
