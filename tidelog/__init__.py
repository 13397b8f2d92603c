"""Spark-native analytics over versioned key-value change logs."""
