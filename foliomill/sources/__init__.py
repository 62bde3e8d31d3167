"""Scans, lookup tables, sinks and the work folder."""
