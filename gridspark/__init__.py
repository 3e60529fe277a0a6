"""Raster elevation data as Spark tables, and operators on them."""
