"""Larkspur: a PySpark-native analytics engine."""
