"""Spark-native interferometric imaging and image analysis."""
