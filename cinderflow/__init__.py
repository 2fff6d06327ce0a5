"""Spark-native analytics for satellite thermal-anomaly detections."""
