"""Spark-native analytics for noisy romanized text."""
