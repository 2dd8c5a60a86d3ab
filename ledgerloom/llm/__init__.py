"""Operators of a training-data pipeline on documents and embeddings.

Nothing outside this subpackage imports it.
"""
