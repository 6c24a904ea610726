"""Spark-native operators for evidence graphs, passage search, event logs and text corpora."""
