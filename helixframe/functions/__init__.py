"""functions of the overlap engine."""
