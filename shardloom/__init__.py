"""Spark-native analytics over ragged event data."""
