"""streaming of the file-collection engine."""
