"""A PySpark-native engine for governed, read-only questions over tabular data."""
