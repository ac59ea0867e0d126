"""siltworks: a PySpark-native engine for preparing and auditing training corpora."""
