"""Spark-native analytics over source symbols, documents and embeddings."""
