"""Profiling operators over DataFrames and over the small tables they produce."""
