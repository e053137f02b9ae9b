"""stemma: a PySpark-native analytics engine for bibliographic corpora."""

__version__ = "0.1.0"
