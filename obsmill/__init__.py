"""obsmill: a PySpark-native engine for messy, multi-source observations."""
