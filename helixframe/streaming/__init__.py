"""streaming of the overlap engine."""
