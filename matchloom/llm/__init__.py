"""Operators for large training-data pipelines: text, media and embedding clean-up on Spark.

Nothing outside this package imports it, so it can be removed without touching the rest.
"""
