"""Spark-native analytics for HTTP access logs."""
