"""quillon: a PySpark-native analytics engine for versioned records and their metrics."""

__version__ = "0.1.0"
