"""quantloom: a Spark-native engine for cross-sectional factor research."""

__version__ = "0.1.0"
