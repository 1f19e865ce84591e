"""Readers of change logs and monitoring tables."""
