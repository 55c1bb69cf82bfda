"""Spark-native engine for building and querying a parent/child knowledge corpus."""
