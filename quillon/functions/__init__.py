"""Column functions and sketches."""
