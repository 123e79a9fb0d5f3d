"""netloom sources."""
