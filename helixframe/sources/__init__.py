"""sources of the overlap engine."""
