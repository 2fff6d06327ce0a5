"""DataFrame operators of the analytics."""
