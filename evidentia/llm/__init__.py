"""Operators for training-data pipelines: ten components over documents, pages and embeddings.

Nothing else in the library imports this subpackage.
"""
