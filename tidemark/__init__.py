"""Queries over versioned, content-addressed file collections, and training-data operators, on Spark."""
