"""Spark-native engine for versioned, permissioned knowledge records."""
