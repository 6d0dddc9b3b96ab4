"""Readers, writers and the shapes of input tables."""
