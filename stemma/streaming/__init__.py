"""streaming of stemma."""
