"""Keyed change-log analytics on PySpark."""
