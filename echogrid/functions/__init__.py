"""Column functions: units, coordinates, amplitudes, thresholds, header texts."""
