"""Operators for training-data pipelines: text, vectors, conversations and urls."""
