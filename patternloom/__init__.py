"""A Spark-native pattern-research engine over bar series."""
