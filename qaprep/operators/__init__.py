"""Operators on columns and DataFrames."""
