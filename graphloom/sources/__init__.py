"""Scans, sinks and the extraction of tables from HTML."""
