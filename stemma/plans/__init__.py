"""plans of stemma."""
