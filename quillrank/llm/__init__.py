"""Operators for large-scale training-data preparation, each a plain Spark job."""
