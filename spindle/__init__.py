"""Spark-native analytics over typed property graphs extracted from web documents."""
