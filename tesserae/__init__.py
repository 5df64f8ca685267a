"""Document retrieval and comparison, and data preparation, on PySpark."""
