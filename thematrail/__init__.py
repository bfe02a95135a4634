"""Spark-native analytics over large collections of written contributions."""
