"""Spark-native full-text search, ranking and corpus-processing engine."""
