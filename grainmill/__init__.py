"""PySpark-native preparation and measurement of language-model training text."""
