"""operators of the file-collection engine."""
