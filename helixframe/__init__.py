"""PySpark-native variant analytics."""
