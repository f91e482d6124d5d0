"""Batch retrieval, corpus and evaluation operators as PySpark DataFrame plans."""
