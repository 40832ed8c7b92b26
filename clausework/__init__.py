"""Document-corpus and retrieval analytics as PySpark DataFrame jobs."""
