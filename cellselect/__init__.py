"""Spark-native geolocation data engine."""
