"""Spark-native analytics for court-sport tracking data."""
