"""tallysheet: a PySpark-native engine for document-derived equipment data."""
