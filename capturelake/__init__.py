"""A PySpark-native analytics engine for large image archives and text corpora."""
