"""Lumen: a PySpark-native automated data-analysis engine."""
