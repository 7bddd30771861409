"""A PySpark-native engine for curating and querying multi-source catalogues."""
