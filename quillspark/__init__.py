"""Spark-native document retrieval: ingest, detect, chunk, embed, index, search, ask."""
