"""Spark jobs for satellite hotspot detections, gridded weather and terrain."""

__version__ = "0.1.0"
