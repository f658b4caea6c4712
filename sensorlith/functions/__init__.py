"""Column functions. Each takes and returns Spark columns; none is a Python UDF."""
