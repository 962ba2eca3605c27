"""Operators of a training-data pipeline, one module each; ``queries`` registers them.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
