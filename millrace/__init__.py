"""Spark-native preparation, profiling and evaluation of large tables and streams."""
