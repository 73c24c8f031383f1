"""Whole queries over the driver tables."""
