"""A PySpark-native analytics engine for notes and documents."""
