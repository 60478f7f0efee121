"""Coordinate-table analytics on Spark: matrices are (i, j, a) DataFrames, vectors (i, a) DataFrames."""
