"""Scans of exported files and the sinks of parsed and published tables."""
