"""Spark-native metadata intelligence and self-service analytics."""
