"""Spark-native geo-analytics engine."""
