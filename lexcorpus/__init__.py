"""Batch and incremental Spark jobs over a corpus of court judgments and training text."""
