"""Watchfold: a PySpark-native engine for security telemetry and temporal graphs."""
