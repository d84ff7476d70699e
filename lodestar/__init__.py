"""Spark-native product search, search analytics and corpus preparation."""
