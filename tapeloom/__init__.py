"""Spark-native screening, replay and grading of daily price panels."""
