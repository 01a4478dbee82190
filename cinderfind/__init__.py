"""Spark-native structured, lexical, dense and hybrid retrieval over document collections."""
