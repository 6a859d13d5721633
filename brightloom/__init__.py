"""Hybrid retrieval, grounding and corpus processing as PySpark plans."""
