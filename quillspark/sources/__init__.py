"""Readers of plain text, feeds and pages."""
