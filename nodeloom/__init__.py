"""Spark-native analytics of relationship networks."""
