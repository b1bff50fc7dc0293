"""PySpark-native analytics for entity-risk data."""
