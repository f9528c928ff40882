"""A Spark-native engine for media-similarity analytics."""
