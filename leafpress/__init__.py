"""Spark-native document extraction and context engine."""
