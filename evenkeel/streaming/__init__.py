"""Skew joins of streams."""
