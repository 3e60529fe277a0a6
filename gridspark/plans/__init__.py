"""Plan patterns that several operators share."""
