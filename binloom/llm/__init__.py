"""Operators of a training-data pipeline over text, embeddings and media columns."""
