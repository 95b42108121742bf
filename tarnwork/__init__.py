"""tarnwork: a PySpark-native engine for technical knowledge records."""
