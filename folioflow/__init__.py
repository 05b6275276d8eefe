"""A PySpark-native engine that refines collections of documents into structured, clean data."""
