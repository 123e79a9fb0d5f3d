"""netloom operators."""
