"""Operators over page rasters, components, text layers, matches and caches."""
