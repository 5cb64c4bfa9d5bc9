"""DataFrame operators of the feedback analysis."""
