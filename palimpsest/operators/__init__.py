"""Operators over write logs and record sets; each takes and returns DataFrames of many entities."""
