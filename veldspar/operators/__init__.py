"""Operators over data and metadata DataFrames."""
