"""Streaming extensions; the base feature set has none."""
