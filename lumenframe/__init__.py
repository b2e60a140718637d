"""Spark-native analytics over volumes, the tables around them, and text corpora."""
