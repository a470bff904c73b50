"""Spark-native property-graph, search and training-data analytics."""
