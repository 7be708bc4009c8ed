"""Spark-native repeat-family analytics over DNA sequence collections."""
