"""Lodestone: a Spark-native mining and analytics engine."""
