"""plans of the overlap engine."""
