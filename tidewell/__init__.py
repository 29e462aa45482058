"""A PySpark-native analytics engine for equity research and risk."""
