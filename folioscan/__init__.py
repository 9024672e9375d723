"""A PySpark-native engine that audits text corpora."""
