"""tripleforge: a PySpark-native engine for knowledge-graph queries and data preparation."""

__version__ = "0.1.0"
