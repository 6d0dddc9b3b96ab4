"""Streaming forms of the audit operators."""
