"""Operators over audits, pages and documents."""
