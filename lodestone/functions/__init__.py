"""Column and matrix functions on vectors."""
