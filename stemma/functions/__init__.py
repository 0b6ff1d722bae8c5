"""functions of stemma."""
