"""A PySpark-native engine: layered tables, identity resolution, features, ranking and search."""
