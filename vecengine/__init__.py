"""A PySpark-native engine for dense-vector similarity search."""
