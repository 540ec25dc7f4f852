"""Column functions over bases, qualities, names and tags."""
