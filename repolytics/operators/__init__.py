"""Operators that take and return DataFrames keyed by repository."""
