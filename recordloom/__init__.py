"""A PySpark-native engine for searching, filtering and sorting large sets of records."""
