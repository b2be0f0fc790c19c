"""Quillon: a Spark-native engine that indexes and searches source code and text."""
