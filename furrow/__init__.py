"""Spark-native analytics for regional, seasonal panel data."""
