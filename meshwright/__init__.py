"""Spark-native analytics over code knowledge graphs and text corpora."""
