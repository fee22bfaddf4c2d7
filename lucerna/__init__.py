"""Lucerna: grounded-evidence analytics on Spark."""
