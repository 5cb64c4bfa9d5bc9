"""Whole analyses and the query catalogue."""
