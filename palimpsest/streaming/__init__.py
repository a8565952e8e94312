"""Incremental upkeep of a log from a stream of writes."""
