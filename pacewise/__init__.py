"""Spark-native accessibility analytics."""
