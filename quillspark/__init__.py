"""Transcript-quality analytics on PySpark: sources, operators, functions and query plans."""

__version__ = "0.1.0"
