"""Spark operators for camera-pipeline metadata: frames, detections, tensors, timings."""

__version__ = "0.1.0"
