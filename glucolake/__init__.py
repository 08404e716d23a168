"""Spark-native analytics for glucose sensor time series."""
