"""Operators on detections, samples, blocks and tables."""
