"""PySpark-native analytics for running a lakehouse."""
