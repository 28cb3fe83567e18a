"""Spark-native engine for monitored-content pipelines."""
