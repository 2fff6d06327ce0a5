"""Column functions: geography, scores, text."""
