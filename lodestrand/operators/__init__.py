"""Operators from DataFrames to DataFrames: retrieval, evidence, memory, sessions, layout, metrics."""
