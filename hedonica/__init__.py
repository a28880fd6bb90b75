"""Spark-native analysis of a skewed price by categorical attributes."""
