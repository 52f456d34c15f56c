"""Spark-native document retrieval, knowledge-graph and text analytics."""
