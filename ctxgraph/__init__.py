"""A PySpark-native engine for code-graph and document analytics."""
