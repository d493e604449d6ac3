"""PySpark-native retrieval and evaluation over versioned, cross-referenced texts."""
