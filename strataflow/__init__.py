"""strataflow: a PySpark-native engine for structured technical documents."""

__version__ = "0.1.0"
