"""Spark-native analytics over threaded discussions."""
