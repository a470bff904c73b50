"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; it can be removed as a whole.
"""
