"""Operators for preparing training data: ten operators, their queries and their SQL.

Nothing outside this folder (but for `corpus_pipeline.py`) imports it.
"""
