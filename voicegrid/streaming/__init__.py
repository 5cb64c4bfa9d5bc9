"""Incremental review intake."""
