"""Column functions for text, numbers and dates."""
