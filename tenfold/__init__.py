"""Spark-native analytics over repeated readings of a ten-frame score display."""
