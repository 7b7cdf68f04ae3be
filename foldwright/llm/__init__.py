"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it, and it can be
deleted together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
