"""Catalog, question planner and guarded SQL."""
