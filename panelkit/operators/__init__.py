"""Operators that take and return DataFrames. Domain column names are arguments."""
