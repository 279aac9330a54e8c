"""A PySpark-native engine: metadata catalog, lineage, guarded SQL, retrieval, and operators for training data."""
