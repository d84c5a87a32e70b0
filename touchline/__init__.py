"""Spatio-temporal match analytics as PySpark DataFrame jobs."""
