"""Spark-native search over hierarchical catalogs, and operators for training-data pipelines."""
