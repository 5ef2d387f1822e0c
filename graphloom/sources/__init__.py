"""Scans and readers."""
