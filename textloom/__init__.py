"""Spark-native analytics over text corpora and small table containers."""
