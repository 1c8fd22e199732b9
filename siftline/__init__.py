"""A PySpark-native engine for fraud-case evidence and for large text corpora."""
