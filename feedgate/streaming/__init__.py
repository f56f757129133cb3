"""The same jobs on unbounded input."""
