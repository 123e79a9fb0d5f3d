"""netloom plans."""
