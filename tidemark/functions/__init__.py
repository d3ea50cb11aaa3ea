"""functions of the file-collection engine."""
