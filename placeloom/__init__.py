"""PySpark-native place search: build a place index from map elements and search it."""
