"""Spark-native quality analytics: relational operators over code, findings, logs and text."""
