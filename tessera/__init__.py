"""Spark-native analytics over a corpus of control frameworks: ingest state, mapping edges, retrieval and its evaluation."""
