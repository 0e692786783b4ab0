"""A PySpark-native analytics engine: typed query operators as DataFrame and SQL plans."""
