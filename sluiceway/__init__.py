"""A PySpark-native data-preparation engine."""
