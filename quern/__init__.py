"""Spark-native corpus preparation, hybrid retrieval and evaluation."""
