"""Spark-native long-read overlap engine."""
