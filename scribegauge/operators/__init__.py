"""Operators: alignment, detection, slots, scoring, rollups and resampling."""
