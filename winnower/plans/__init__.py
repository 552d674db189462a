"""Named entry points: one function for each published tool, and SQL functions."""
