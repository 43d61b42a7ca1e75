"""Larkspur: a Spark-native analytics engine over DataFrames, Spark SQL and Structured Streaming."""
