"""Column expressions: colour, spectral, radar, scores, coordinates, text. No Python runs per row."""
