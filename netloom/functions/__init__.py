"""netloom functions."""
