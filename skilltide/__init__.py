"""Spark-native skill-demand analytics: every public operator is DataFrame -> DataFrame."""
