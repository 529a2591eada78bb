"""Spark-native entity resolution, graph retrieval and data-processing operators."""
