"""A PySpark-native engine for decomposing, comparing and scoring large collections of long documents."""

__version__ = "0.1.0"
