"""Spark-native operators for text-risk pipelines."""
