"""Operators for large-scale training-data pipelines, built on Spark DataFrames.

Nothing else in the library imports this package; it can be removed as a whole.
"""
