"""A PySpark-native analytics engine for sports tracking data and training-data preparation."""
