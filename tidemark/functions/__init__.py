"""Column builders: scalar helpers and the transformation rules."""
