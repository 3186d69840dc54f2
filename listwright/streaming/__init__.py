"""List files that arrive over time."""
