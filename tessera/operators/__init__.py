"""Statements lowered to DataFrames and to changes of stored tables."""
