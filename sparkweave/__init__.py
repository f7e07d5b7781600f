"""Spark-native triple store and graph-pattern queries."""
