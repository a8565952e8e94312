"""Palimpsest: bitemporal entity history on Spark."""
