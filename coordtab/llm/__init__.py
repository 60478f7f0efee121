"""Operators for training-data pipelines over documents. Nothing else in the package imports this."""
