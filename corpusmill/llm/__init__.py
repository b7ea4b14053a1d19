"""Operators for training-data pipelines at scale."""
