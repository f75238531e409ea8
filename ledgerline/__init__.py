"""Spark-native analytics over decision logs, edits, embeddings and experiments."""
