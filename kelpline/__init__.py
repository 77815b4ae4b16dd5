"""Spark-native engine for positional text indexes, ranked retrieval and text corpora."""
