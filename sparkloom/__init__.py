"""Spark-native weighted-graph, histogram and timing analytics."""
