"""Spark-native analytics over crawled web pages."""
