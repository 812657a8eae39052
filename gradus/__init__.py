"""Spark-native analytics for image-degradation robustness studies."""
