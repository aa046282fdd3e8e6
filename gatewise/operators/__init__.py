"""Operators over object tables: gates, populations, statistics, merges, plot data."""
