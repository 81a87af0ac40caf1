"""Operators over the graph tables; each takes and gives DataFrames."""
