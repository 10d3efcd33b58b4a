"""Operators for large training-data pipelines: ten corpus operators, their queries and their SQL."""
