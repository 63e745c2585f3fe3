"""codelore: a PySpark-native engine for understanding large text and source-code corpora."""
