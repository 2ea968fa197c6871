"""Spark-native analytics over evidence-backed property graphs."""
