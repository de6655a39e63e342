"""Readers of a check's two sides."""
