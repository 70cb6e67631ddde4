"""lineforge: a PySpark-native engine for self-describing record containers and sequence data."""

__version__ = "0.1.0"
