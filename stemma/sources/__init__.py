"""sources of stemma."""
