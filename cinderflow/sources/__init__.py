"""Readers and normalizers of detections, map features and weather."""
