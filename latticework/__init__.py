"""Spark-native analytics over typed, confidence-weighted property graphs."""
