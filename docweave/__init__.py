"""A Spark-native engine for document collections, change logs and rules."""
