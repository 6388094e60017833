"""Spark-native document analytics."""
