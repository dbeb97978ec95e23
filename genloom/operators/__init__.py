"""Relational operators on DataFrames, and the kernels that executors run."""
