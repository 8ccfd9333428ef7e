"""Column functions: reproducible randomness and vector arithmetic."""
