"""Spark-native vector memory engine."""
