"""Reading source tables and writing target and control tables."""
