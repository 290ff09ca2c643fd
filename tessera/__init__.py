"""Guarded SQL analytics on PySpark."""
