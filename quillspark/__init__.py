"""A PySpark-native engine for corpus processing, hybrid retrieval and text analytics."""

__version__ = "0.1.0"
