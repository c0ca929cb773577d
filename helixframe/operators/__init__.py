"""operators of the overlap engine."""
