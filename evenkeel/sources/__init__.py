"""Readers, fixtures, generators."""
