"""Operators over index and scan DataFrames."""
