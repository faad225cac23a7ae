"""File and table sources, and published generations."""
