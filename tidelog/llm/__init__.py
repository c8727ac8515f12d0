"""Operators for preparing language-model training data.

Nothing outside this package (but ``corpus_pipeline.py``) imports it.
"""
