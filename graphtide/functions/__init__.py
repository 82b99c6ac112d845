"""Column functions and text functions."""
