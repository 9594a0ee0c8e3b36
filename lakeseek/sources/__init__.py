"""Scans, sinks, catalog and shared storage."""
