"""Quillon: governed metrics and data-quality analytics on PySpark."""
