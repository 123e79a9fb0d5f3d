"""netloom streaming."""
