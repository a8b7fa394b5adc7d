"""Spark-native engine for declared, keyed tables."""
