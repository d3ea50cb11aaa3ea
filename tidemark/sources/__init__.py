"""sources of the file-collection engine."""
