"""Terrane: spatial, tagged-data and tiling analytics as Spark plans."""
