"""Spark-native analytics over corpora of labelled code changes."""
