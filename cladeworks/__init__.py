"""Spark-native analytics over hierarchical code taxonomies."""
