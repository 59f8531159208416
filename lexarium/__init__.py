"""Spark-native text analytics and information retrieval."""
