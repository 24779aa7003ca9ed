"""Column-level helpers: typed ids, validity intervals, property bags."""
