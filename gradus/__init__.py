"""A PySpark-native engine for relevance judging and retrieval evaluation."""
