"""A PySpark-native engine that shrinks, ranks, screens and measures text."""
