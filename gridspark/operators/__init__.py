"""Operators on pixel, tile, object and metric tables."""
