"""Operators for large training-data pipelines.

Nothing outside this package imports it; ``queries.py`` registers their
queries and ``corpus_pipeline.py`` chains five of its operators.
"""
