"""Spark-native building, searching and evaluating of document collections."""
