"""Accessibility-audit analytics on Spark DataFrames."""
