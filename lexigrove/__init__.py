"""PySpark-native full-text search and retrieval analytics."""
