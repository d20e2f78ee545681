"""Audit and forensic analytics over accounting ledgers, written as PySpark DataFrame jobs."""

__version__ = "0.1.0"
