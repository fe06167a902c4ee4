"""Column functions: every function takes columns and returns a column, no shuffle, no UDF."""
