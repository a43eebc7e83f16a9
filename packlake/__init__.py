"""packlake: a PySpark-native engine over repository tables and text corpora."""

__version__ = "0.1.0"
