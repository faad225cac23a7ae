"""The query language, its compilation to DataFrames, and the registered queries."""
