"""Spark-native analytics for object tracks and keyed event streams."""
