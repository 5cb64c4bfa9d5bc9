"""Readers, writers and source projections."""
