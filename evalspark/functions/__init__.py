"""Column functions: pure expressions over Spark's own functions."""
