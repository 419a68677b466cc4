"""Spark-native candle analytics engine."""
