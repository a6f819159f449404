"""A PySpark-native engine for panel and time-series research."""
