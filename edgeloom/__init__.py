"""Graph-embedding data processing and analytics on PySpark."""
