"""A PySpark-native engine for code graphs: extraction, resolution, traversal, search."""

__version__ = "0.1.0"
