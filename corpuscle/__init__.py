"""A Spark-native engine for particle interaction analytics."""
