"""Joins, aggregates, windows and set operations on DataFrames."""
