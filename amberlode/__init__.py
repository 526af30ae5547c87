"""A Spark-native engine for a provenance-first knowledge base."""
