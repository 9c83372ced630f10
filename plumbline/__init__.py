"""Spark-native analytics for retrieval evaluation and training-data preparation."""
