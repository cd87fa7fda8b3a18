"""Tessaro: point-in-time research analytics and corpus processing on PySpark."""
