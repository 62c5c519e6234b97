"""Relational, sequence and clustering operators on DataFrames."""
