"""Velarium: a PySpark-native engine for person-name authority data."""
