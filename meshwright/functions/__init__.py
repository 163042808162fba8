"""Column functions: geodesy, radio, text."""
