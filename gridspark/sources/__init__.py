"""Readers, writers and the fixtures that turn the given tables into rasters."""
