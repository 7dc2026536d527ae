"""Readers and the dataset registry."""
