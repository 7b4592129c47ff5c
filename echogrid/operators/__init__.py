"""DataFrame operators over traces, bins, lines and slices."""
