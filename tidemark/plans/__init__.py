"""plans of the file-collection engine."""
