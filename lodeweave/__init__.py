"""Spark-native analytics over source trees, document corpora and event logs."""
