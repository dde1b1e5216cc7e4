"""A PySpark-native engine for paralog evolution along a species tree."""
