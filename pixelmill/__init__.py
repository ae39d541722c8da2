"""Spark-native image-metadata, crop-geometry and pixel operators."""
