"""Whole runs put together from the table jobs."""
