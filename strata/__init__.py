"""strata: a PySpark-native engine for code-structure and document-corpus queries."""
