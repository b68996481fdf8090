"""Spark-native evidence retrieval over timed transcripts, and preparation of training text."""
