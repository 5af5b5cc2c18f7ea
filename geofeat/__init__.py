"""Spark-native geospatial flood and heat feature engine."""
