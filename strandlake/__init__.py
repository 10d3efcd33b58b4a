"""Sequence-database analytics on Spark."""
