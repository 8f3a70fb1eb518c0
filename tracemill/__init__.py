"""tracemill: a PySpark-native engine for replaying and analysing event traces."""

__version__ = "0.1.0"
