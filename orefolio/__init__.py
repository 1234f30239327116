"""A PySpark-native engine for tables of report pages and the structured fields read from them."""
