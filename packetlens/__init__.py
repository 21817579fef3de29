"""Capture analytics on Spark."""
