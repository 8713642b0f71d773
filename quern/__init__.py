"""A Spark-native engine for full-text retrieval experiments."""
