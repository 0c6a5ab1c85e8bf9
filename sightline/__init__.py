"""PySpark-native analytics over time-ordered observation tables."""
