"""Connectors: tile archives, tile databases, feeds, listings, recipes and shapes."""
