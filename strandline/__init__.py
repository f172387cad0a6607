"""Spark-native analytics over moving-object event streams and road graphs."""
