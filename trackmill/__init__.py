"""Spark-native analytics over object tracks and the timed events inside them."""
