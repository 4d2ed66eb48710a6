"""Column functions over time-ordered windows."""
