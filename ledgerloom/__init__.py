"""Spark-native analytics for financial operations data."""
