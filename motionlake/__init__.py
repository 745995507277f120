"""Spark-native analytics over series, grids and event streams."""
