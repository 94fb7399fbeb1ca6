"""Detectors, routers, joins and metrics."""
