"""Ranked-entry analytics on Spark."""
