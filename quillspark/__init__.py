"""quillspark: a PySpark-native engine for building auditable plain-text corpora."""
