"""A PySpark-native engine for selecting and validating biomarker panels."""
