"""operators of stemma."""
