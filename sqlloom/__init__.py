"""Spark-native analytics over large collections of SQL text and execution plans."""
