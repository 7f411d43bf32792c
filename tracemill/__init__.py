"""Spark-native analytics over recorded coding-agent sessions."""
